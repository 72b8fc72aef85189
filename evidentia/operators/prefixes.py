"""What a set of tokens is found by: its rarest tokens, its size and a parity code, computed a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from evidentia.session import ship

ship(__name__)

CELLS = 1 << 20
CODE_WORDS = 4
POSTING = "id long, n int, pos int, short boolean, key long, " + ", ".join(f"c{i} long" for i in range(CODE_WORDS))
#: Sets that are laid out at once.
ROWS = 2_000


def postings(threshold: float, met: np.ndarray):
    """For mapInArrow over id and h, the hashes of a set's tokens: a row for each token among the rarest that a pair in reach of the threshold can share first.

    met has how many sets hold a token of each cell; tokens are in order of that and of their hash, and one whose cell is
    met once is in no other set. `short` marks those that are enough for the shorter set of a pair. Two codes differ in no
    more bits than the sets in tokens, as each token falls to one bit and turns it.
    """

    def laid_out(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("h")
        n = lists.value_lengths().to_numpy().astype(np.int64)
        h = lists.flatten().to_numpy().view(np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        bits = 64 * CODE_WORDS
        turned = np.bincount(row * bits + (h >> np.uint64(40)).astype(np.int64) % bits, minlength=len(n) * bits) & 1
        codes = np.packbits(turned.astype(np.uint8)).view(np.int64).reshape(len(n), CODE_WORDS)
        often = met[(h & np.uint64(CELLS - 1)).astype(np.int64)]
        order = np.lexsort((h, often, row))
        pos = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        long = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
        short = n - np.ceil(2 * threshold / (1 + threshold) * n - 1e-9).astype(np.int64) + 1
        keep = (pos < long[row]) & (often[order] > 1)
        row, pos, order = row[keep], pos[keep], order[keep]
        columns = [batch.column("id").take(pa.array(row)), n[row].astype(np.int32), pos.astype(np.int32), pos < short[row], h[order].view(np.int64), *codes[row].T]
        return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names=[x.split()[0] for x in POSTING.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                yield laid_out(batch.slice(at, ROWS))

    return run
