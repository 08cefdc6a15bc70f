"""Alignment of two tokenizers against plain Python over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from weftline.llm import alignment
from weftline.llm.bpe import id_to_piece
from weftline.llm.registry import QUERIES

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def whole():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    piece = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]

    def encode(text):
        """Tokens of the whole text, (id, end), or none."""
        sides = []
        for ids, of in ((a.encode(" " + text, add_special_tokens=False).ids, id_to_piece(A)), (b.encode(text), piece)):
            if b"".join(of[i] for i in ids) != b" " + text.encode():
                return [], []
            end, side = 0, []
            for i in ids:
                end += len(of[i])
                side.append((i, end))
            sides.append(side)
        return sides

    return encode


def brute(encode, docs):
    links, rows = {}, []
    for k, (i, text) in enumerate(docs):
        a, b = encode(text) if text else ([], [])
        links[k] = []
        for x, (ia, ea) in enumerate(a):
            sa = a[x - 1][1] if x else 0
            for y, (ib, eb) in enumerate(b):
                if max(sa, b[y - 1][1] if y else 0) < min(ea, eb):
                    links[k].append((ia, ib))
        groups, ga, gb = [], [], []
        common = {e for _, e in a} & {e for _, e in b}
        for end in sorted(common):
            first = [i for i, e in a if e <= end][len(ga) :]
            second = [i for i, e in b if e <= end][len(gb) :]
            ga, gb = ga + first, gb + second
            groups.append(",".join(map(str, first)) + "|" + ",".join(map(str, second)))
        rows.append((i, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    n = Counter(p for x in links.values() for p in x)
    most = defaultdict(int)
    for (_, ib), c in n.items():
        most[ib] = max(most[ib], c)
    return sorted(((i, na, nb, g, len(links[k]), sum(n[p] == most[p[1]] for p in links[k]), sum(n[p] for p in links[k]), h) for k, (i, na, nb, g, h) in enumerate(rows)), key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


TEXTS = [None, "", " ", "a", "a ", "  a", "a  b   c", "don't stop\n\n now\t x ", "<|endoftext|> and </s> <0x41>", "Ünïcödé 漢字 😀    y", "x▁y", "ab" * 200, "１２ 3 \x00 \x1c c", "ｆｕｌｌ ﬁ é"]


def test_equal_to_brute_force(spark, whole):
    docs = [(k, x) for k, x in enumerate(TEXTS)] + [(3, "a"), (50, "the cat sat on the unbelievable mat " * 3), (51, "the cat")]
    df = spark.createDataFrame([(i, x, 1, "n") for i, x in docs], "doc_id long, text string, n_a int, block string").repartition(3)
    expected = brute(whole, docs)
    assert rows_of(alignment.aligned_counts(df, A, B)[0]) == expected
    documents, counts = alignment.aligned_counts(df, A, B, block_bytes=20)
    assert rows_of(documents) == expected
    assert sum(r["n"] for r in counts.collect()) == sum(r[4] for r in expected)
    none = alignment.aligned_counts(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert none[0].count() == 0 and none[1].count() == 0


def test_words_encode_as_whole_texts(whole):
    """Odd texts, by words and as wholes, have the same tokens."""
    random.seed(3)
    p = alignment.pair(A, B)
    assert not p.joins
    parts = [" ", "  ", "\n", "\t", "a", "Abc", "é", "漢", "😀", "▁", "<s>", "12", "'s", ".", " ", "　", "zz", "\x00", "the"]
    texts = ["".join(random.choices(parts, k=random.randint(1, 12))) for _ in range(3000)]
    ids_a, ids_b = alignment.Encoded(p, texts).ids(0, len(texts))
    assert [x.ids for x in p.a.encode_batch([" " + x for x in texts], add_special_tokens=False)] == ids_a.to_pylist()
    plain = ["▁" not in x for x in texts]  # others have no tokens
    assert [x for x, fits in zip(p.b.encode(texts), plain) if fits] == [x for x, fits in zip(ids_b.to_pylist(), plain) if fits]
    assert alignment.covering(p, ids_a, ids_b, texts).tolist() == plain


def test_query(spark, folder, whole):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op13_alignment"](spark, folder).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        a, b = whole(text) if text else ([], [])
        ends = [{e for _, e in x} for x in (a, b)]
        assert (got[i]["n_a"], got[i]["n_b"], got[i]["n_groups"], got[i]["n_links"]) == (len(a), len(b), len(ends[0] & ends[1]), len(ends[0] | ends[1]))
