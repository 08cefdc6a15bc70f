"""What a worker keeps of the blocks that it has made."""

import subprocess
import sys

KEPT = """
import ctypes, re
from pathlib import Path
import numpy as np, pyarrow as pa
import weftline.llm.blocks as blocks, weftline.llm.bpe as bpe

class Context:
    get = staticmethod(lambda: Context)
    partitionId = staticmethod(lambda: 0)

blocks.TaskContext = Context
mb = lambda: int(re.search(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
words = np.array([f"word{k}" for k in range(60000)])
rng = np.random.default_rng(1)
rows = pa.record_batch({"doc_id": pa.array(range(4000)), "_text": pa.array([" ".join(words[rng.integers(0, len(words), 500)]) for _ in range(4000)])})
pa.default_memory_pool().release_unused()
ctypes.CDLL(None).malloc_trim(0)
before = mb()
for made in bpe.block_rows(iter([rows, rows]), "_text", 8, 8 << 20):
    del made
print(mb() - before)
"""


def test_a_worker_gives_its_blocks_memory_back():
    """An idle worker kept some 80 MB of free memory, beside the next stages' own."""
    out = subprocess.run([sys.executable, "-c", KEPT], capture_output=True, text=True, check=True)
    assert float(out.stdout) < 30, out.stdout
