"""The small labelled table for HTML extraction: pages written for it, and the words that mark their content blocks."""

import re

LABELLED_PAGES: list[tuple[str, list[str]]] = [
    (
        """<html><head><title>t</title></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>World</a></li></ul></nav>
        <div class="ad">KEEPOUT Buy the best kettle now for a small price today only</div>
        <article><h1>CONTENT The harbour at dawn</h1><p>CONTENT Boats came in before the sun and the nets were full of silver fish for the market.</p><p>CONTENT Short.</p>
        <ul><li>CONTENT first point of the list</li><li>CONTENT second point</li></ul><p>CONTENT See <a href=/x>the full report</a> for figures.</p></article>
        <footer>Copyright Example Press, all rights reserved, written by people who care about harbours</footer></body></html>""",
        ["CONTENT"],
    ),
    (
        """<body><header><div>The Daily Example</div><a href=/>Start</a></header><div id="cookie-notice">We use cookies to make this site better for every reader, please agree.</div>
        <main><h1>CONTENT Rain in the hills</h1><p>CONTENT It rained for three days and the river rose above the old bridge near the mill.</p><p>CONTENT No one was hurt.</p></main>
        <aside class="sidebar"><h3>Most read</h3><p>Five ways to keep your boots dry in a wet season, by our outdoor desk</p></aside>
        <section class="comments"><h2>Comments</h2><p>I live there and the water was higher than they say, it reached my door.</p><p>Good text!</p></section>
        <form><p>Sign up to our letter and get news every morning before breakfast</p><label>Mail</label></form><footer><p>About us</p></footer></body>""",
        ["CONTENT"],
    ),
    (
        """<body><div class="menu"><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div class="post-content"><h2>CONTENT Bread without yeast</h2>
        <p>CONTENT Mix flour and water, leave it for a day and then fold it four times before you bake it.</p><p>CONTENT Serve warm.</p><p>CONTENT Thanks for reading about bread.</p></div>
        <div class="share-buttons">Share this with friends on every network you know</div><div class="related"><p>You may also like our long guide to soups and stews of the north</p></div>
        <div id="footer">Terms and privacy and contact for the whole group of papers</div></body>""",
        ["CONTENT"],
    ),
    (
        """<body><table><tr><td><a href=1>Sport</a></td><td><a href=2>Arts</a></td></tr></table>
        <h1>CONTENT A quiet election in the valley towns</h1><div>CONTENT Voters went to the school hall in small groups all day long, and the count was over before ten in the evening.</div>
        <div>CONTENT The mayor keeps the office for another four years, with a council that has two new members from the farms.</div>
        <p><a href=5>Next page of the archive</a> <a href=6>Previous page of the archive</a></p><p>Log in</p></body>""",
        ["CONTENT"],
    ),
    (
        """<body><article><header><h1>CONTENT Old maps found</h1></header><div class="advert">Cheap flights to the sun, book before Friday and save a lot of money</div>
        <p>CONTENT A box in the cellar held forty maps of the coast drawn two hundred years ago by a pilot.</p><p>CONTENT They can be seen from May.</p>
        <aside>Related story about ships and the men who drew the first charts of this coast</aside><div class="comment-list"><p>My uncle had one of these maps on his wall for years and years.</p></div></article></body>""",
        ["CONTENT"],
    ),
    (
        """<body><div role="navigation"><ul><li><a href=1>A</a></li><li><a href=2>B</a></li></ul></div><div class="notice">This site is moving to a new address in the next month, please update your bookmarks.</div>
        <article><p>CONTENT Only one paragraph here.</p></article><div class="newsletter">Get the weekly letter with all our stories sent to your inbox for free</div></body>""",
        ["CONTENT"],
    ),
    (
        """<body><p>CONTENT There is no frame on this page, only a few paragraphs of plain text that someone wrote by hand in an editor long ago.</p>
        <p>CONTENT The second paragraph is shorter than the first, but it has a dozen words or so.</p><p>CONTENT End of the note about nothing much at all.</p>
        <p><a href=1>back</a> <a href=2>index</a> <a href=3>mail</a></p></body>""",
        ["CONTENT"],
    ),
    (
        """<body><span>Menu</span><p>Skip</p><article><h1>CONTENT Note</h1><p>CONTENT One.<p>CONTENT Two.<p>CONTENT Three words here.<p>CONTENT End""",
        ["CONTENT"],
    ),
    (
        """<body><p>Welcome back</p><p>Sign in</p><article><h1>CONTENT Poem</h1><p>CONTENT Yes.</p><p>CONTENT No.</p></article></body>""",
        ["CONTENT"],
    ),
    (
        """<body><div>Close</div><div>Open</div><main><p>CONTENT A.</p><p>CONTENT B c.</p></main><div>Top</div><div>Print</div></body>""",
        ["CONTENT"],
    ),
    (
        """<body><div>Edition of Monday</div><article><h1>CONTENT Links</h1><p><a href=1>CONTENT A story that is all one link to another story</a></p><p>CONTENT And a word.</p></article><p>Back to top</p></body>""",
        ["CONTENT"],
    ),
    (
        """<body><div>All rights reserved</div><article><p>CONTENT Text.</p></article><div>Made by hand</div><div>A page about nothing with a few words more than the others have in their frames here</div></body>""",
        ["CONTENT"],
    ),
    (
        """<body><article><div class="article-body"><h2>CONTENT Sea</h2><p>CONTENT Waves.</p></div></article></body>""",
        ["CONTENT"],
    ),
    (
        """<body><div class="content"><p>CONTENT The mill stood by the river for three hundred years until the flood took its wheel away.</p><p>CONTENT Gone now.</p></div><p>Back</p></body>""",
        ["CONTENT"],
    ),
    (
        """<body><div class="entry"><p>CONTENT So it goes.</p></div></body>""",
        ["CONTENT"],
    ),
    (
        """<body><p>CONTENT A walk along the coast path takes four hours if you stop for tea at the light and look at the birds on the rocks below.</p>
        <footer>Copyright by the walking club of the county, founded by nine friends who liked wind and rain and long days out on the hills together</footer></body>""",
        ["CONTENT"],
    ),
    (
        """<body><header>The club of walkers on this coast meets each Sunday at the station, whatever the weather, and all who have boots are welcome to come</header>
        <div class="text"><p>CONTENT The path was cut by miners who went down to the sea at night to fish, and it still has steps that they made in the rock.</p></div>
        <aside>In the next number we write of the old railway and of the people who lived along the line before it was closed for good</aside></body>""",
        ["CONTENT"],
    ),
    (
        """<body><article><p>CONTENT Salt was made here by boiling the water of the sea in iron pans over fires of wood from the hills behind the town.</p></article>
        <div class="comments"><p>When I was a child my father showed me the place where the pans had stood, and there was still ash in the soil there.</p><p>We went there in spring and saw nothing at all, but the tea room by the church was open and the cake was very good.</p></div>
        <div class="sponsored">Our partner sells salt from the best pans of the west in small bags that make a fine present for all who like to cook</div>
        <footer>This page was made by the friends of the salt works with help from the lottery and from the many people who gave us their time</footer></body>""",
        ["CONTENT"],
    ),
    (
        """<body><form>Tell us what you think of our pages by writing a few lines into the box below and sending them with the button under it please</form>
        <p>CONTENT Each pan had a name, and the workers drank to it when the first salt of the year was drawn up on the boards to dry.</p>
        <div class="cookie-banner">We and our many partners store data on your device to show you adverts and to learn how our pages are used by readers</div>
        <nav>Up to the list of all pages on salt, or down to the next page in the row, which is on the trade in salt fish</nav></body>""",
        ["CONTENT"],
    ),
    (
        """<p>CONTENT A page can be as plain as this one, with two paragraphs and nothing else around them at all.</p><p>CONTENT The second one is the last thing on the page and it is just as much its content.</p>""",
        ["CONTENT"],
    ),
    (
        """<body><p>CONTENT We sold the boat in the autumn and bought a smaller one in spring, which was easier to keep.</p><div>CONTENT It lay in the harbour for two years before we took it out for the first long trip to the islands.</div><div>Print</div></body>""",
        ["CONTENT"],
    ),
    (
        """<body><div>Welcome to us</div><div>CONTENT The old road over the pass is closed from the first snow until the middle of May in most years.</div></body>""",
        ["CONTENT"],
    ),
    (
        """<body><h2>CONTENT How to mend a net by hand</h2><p>CONTENT Cut the torn part out until every edge has clean knots, then tie new meshes one after the other.</p><p><a href=1>A long list of links to other pages on nets and lines and hooks</a></p></body>""",
        ["CONTENT"],
    ),
]

# Pages whose frames carry no names: what tells a block is its words, its links and those of its neighbours.
_LONG = [
    "CONTENT The ferry leaves the north quay twice a day in winter, and the crossing takes a little under two hours when the wind is from the west.",
    "CONTENT In the years after the war the yard built forty boats of this kind, most of them for owners who lived on the outer islands.",
    "CONTENT Nobody in the village could say who had planted the avenue of limes, but the oldest of the trees is thought to be three hundred years old.",
    "CONTENT The council will vote on the plan in June, after a hearing at which everyone who lives along the road may speak for five minutes.",
    "CONTENT She kept a diary of the weather from the age of nine, and her notes are now used to check what the instruments of that time had shown.",
    "CONTENT When the mill was closed the wheel stood still for the first time since the flood, and people came to look at it on their way from church.",
]
_SHORT = ["CONTENT No.", "CONTENT He did not agree.", "CONTENT That was all.", "CONTENT The price: four shillings.", "CONTENT So they waited.", "CONTENT Why?"]
_MENU = ["Home", "News", "Local sport", "Weather", "Jobs", "Culture and arts", "Letters", "Archive"]
_MORE = ["Ten walks for a wet weekend", "The best cafes by the sea", "Why the old school was sold", "A day with the lifeboat crew", "Our photographs of the year"]
_CALLS = [
    "Subscribe to our newsletter and get the best stories of the week by mail.",
    "Sign up for free and never miss an update from us again.",
    "We use cookies to improve this site. By using it you accept our privacy policy.",
    "Advertisement: save up to half the price on new tyres, only this week.",
    "Follow us on every network and share this story with your friends.",
    "Please log in or register to read more and to leave a comment.",
]
_ENDS = ["Copyright 2019 Example Press. All rights reserved.", "Terms of use and privacy policy and imprint", "Powered by a free theme for small papers"]


def _links(names: list[str], item: str = "li") -> str:
    return "".join(f"<{item}><a href=/x>{n}</a></{item}>" for n in names)


def _text(parts: list[str], item: str = "p") -> str:
    return "".join(f"<{item}>{x}</{item}>" for x in parts)


def _composed() -> list[str]:
    """Pages put together from the lists above, one after the other in fixed rotations."""
    out = []
    for k in range(6):
        long, short = _LONG[k:] + _LONG[:k], _SHORT[k:] + _SHORT[:k]
        menu, more, call, end = _MENU[k % 4 : k % 4 + 4], _MORE[k % 3 : k % 3 + 3], _CALLS[k], _ENDS[k % 3]
        head = f"<h1>CONTENT The {('harbour', 'yard', 'avenue', 'road', 'diary', 'mill')[k]}</h1>"
        item = ("p", "div")[k % 2]
        story = _text([long[0], short[0], long[1], long[2], short[1], long[3]], item)
        # neither main part nor names
        out.append(f"<body><ul>{_links(menu)}</ul>{head}{story}<ul>{_links(more)}</ul><{item}>{call}</{item}><{item}>{end}</{item}></body>")
        out.append(f"<body><{item}>{call}</{item}><{item}>{' '.join(f'<a href=/y>{n}</a>' for n in menu)}</{item}>{head}{story}<{item}><a href=/n>Next</a> <a href=/p>Previous</a></{item}></body>")
        # the main part takes in what stands around the story
        out.append(f"<body><main><ul>{_links(menu)}</ul>{head}{story}<h3>{_MORE[k % 5]}</h3><ul>{_links(more)}</ul><p>{call}</p></main><p>{end}</p></body>")
        # an article with lists of links and of text, with single links, a formula, its author and tags
        listed = _text(["CONTENT the keel, of oak from the valley", "CONTENT two masts", "CONTENT a cabin with <a href=/c>four berths</a>"], "li")
        out.append(f"<body><article>{head}<p class='byline'>CONTENT By A. Writer</p>{_text(long[:2])}<ul>{_links(more)}</ul>{_text([long[2]])}<ul>{listed}</ul><p><a href=/r>CONTENT Read the report of the harbour board</a></p>{_text([short[0], long[3]])}<p class='tags'>CONTENT Filed under boats</p><p>CONTENT {end}</p></article></body>")
        out.append(f"<body><div class='layout has-sidebar'><article>{head}{_text([short[0], long[0]])}<p><a href=/s>{call}</a></p>{_text([long[1], short[1], short[2]])}</article><div>{_links(more, 'p')}</div></div></body>")
        # articles and main parts of paragraphs and headings of all lengths, one word included
        words = " ".join(x.removeprefix("CONTENT ") for x in long).split()
        for m, mark in enumerate(("article", "main", "article")):
            sizes = [(i * i * 7 + k * 5 + m * 11) % (8 if i % 3 else 45) + 1 for i in range(14)]
            cut = [f"CONTENT {' '.join(words[i : i + n])}" for i, n in enumerate(sizes)]
            out.append(f"<body><ul>{_links(menu)}</ul><div>{_MORE[m]}</div><{mark}><h1>{cut[0]}</h1>{_text(cut[1:5])}<h2>{cut[5]}</h2>{_text(cut[6:12])}<h3>{cut[12]}</h3><p>{cut[13]}</p></{mark}><div>{words[k]}</div><div>{end}</div></body>")
        out.append(f"<body><div class='story'>{head}{_text([long[4], short[3], short[4], long[5]])}</div><p>{call}</p><p>{end}</p></body>")
    return out


# Articles in which words of calls and of frames are words of the story, and names that only sound like a frame's.
_STORIES = [
    ["CONTENT Bake the cookies for ten minutes until they are brown at the edges.", "CONTENT Cookies keep for a week in a tin.", "CONTENT A newsletter of the guild from 1890 has the recipe."],
    ["CONTENT Voters must register before the first of May at the town hall.", "CONTENT To register they need a letter with their name.", "CONTENT Those who subscribe to the plan pay more."],
    ["CONTENT The court said that all rights reserved to the crown in the old charter still stand.", "CONTENT Privacy was the first word of the report.", "CONTENT An advertisement of that year shows the shop."],
]
_NEUTRAL = ["ad-free-content", "legal-analysis", "cookie-recipes", "notice-period-guide", "search-for-truth", "share-prices"]
_COMMENT = ["I had the same thing happen to me last year and nobody would say why.", "Well said.", "Not true at all, I was there on both days."]


def _spoken() -> list[str]:
    """Pages of the lists above: without and with names, with comments that have none, and with headings of lists of links."""
    out = []
    for k, name in enumerate(_NEUTRAL):
        long, mark = _LONG[k:] + _LONG[:k], ("article", "main", "div id=content")[k % 3]
        story, end = [x for n, x in enumerate(long[:3]) for x in (x, _STORIES[(k + n) % 3][n])], mark.split()[0]
        head = f"<h1>CONTENT The {('oven', 'vote', 'charter', 'guide', 'search', 'price')[k]}</h1>"
        out.append(f"<body><ul>{_links(_MENU[:4])}</ul><{mark}>{head}{_text(story)}</{end}><div>{_ENDS[k % 3]}</div></body>")
        out.append(f"<body><{mark}><div class='{name}'>{head}{_text(story[:3])}</div></{end}><p>{_CALLS[k]}</p></body>")
        out.append(f"<body><{mark}><div class='{name}'>{_text(story)}</div></{end}><ul>{_links(_MORE)}</ul></body>")
        marked = "".join(f"<p class='{('text-comment', 'ad-free', 'legal-note')[n % 3]}'>{x}</p>" for n, x in enumerate(story))
        said = "".join(f"<article><p>{x}</p></article>" for x in _COMMENT[k % 2 :])
        out.append(f"<body><article>{head}{marked}<section><h2>{('Comments', 'What readers say', '3 replies')[k % 3]}</h2>{said}</section></article></body>")
        out.append(f"<body><article>{head}{_text(story[:5])}<div><h2>{('Comments', 'Talk', 'Replies')[k % 3]}</h2>{said}</div></article></body>")
        # frames without names inside the main part
        for end in ("article", "main"):
            frames = [f"<form>{_COMMENT[0]} <input></form>", f"<aside>{long[4].removeprefix('CONTENT ')}</aside>", f"<nav>{long[5].removeprefix('CONTENT ')}</nav>", f"<footer><p>{_COMMENT[2]}</p></footer>"]
            out.append(f"<body><{end}>{head}<p>{story[0]}</p>{frames[k % 4]}<p>{story[1]}</p>{frames[(k + 1) % 4]}<p>{_SHORT[k]}</p></{end}></body>")
        out.append(f"<body><article>{head}{_text(story)}<h3>{('More stories', 'Read next', 'Also on this site')[k % 3]}</h3><ul>{_links(_MORE[:3])}</ul></article><footer><p>{_ENDS[k % 3]}</p></footer></body>")
        out.append(f"<body><article>{head}{_text(story[:2])}<h2>CONTENT {('In the oven', 'At the hall', 'In court')[k % 3]}</h2>{_text(story[2:])}<div class='post-comments'><h3>Comments</h3>{_text(_COMMENT)}</div></article></body>")
    return out


LABELLED_PAGES += [(page, ["CONTENT"]) for page in _composed() + _spoken()]

# the same pages without the mark of their main part
LABELLED_PAGES += [(re.sub(r"<(/?)(?:article|main)\b", r"<\1div", page), marks) for page, marks in LABELLED_PAGES[:23] if "<article" in page or "<main" in page]
