"""Which documents hold passages of held-out test items.

An inverted BM25 index of the test items is sent to the tasks; every training passage
queries it by block-max WAND and all items above the threshold are verified word by
word.  Documents are read once and nothing but the findings is shuffled.

The threshold loses nothing: an item's postings are divided by the least score that
any run of ``min_words`` consecutive words of the item can reach, so a passage that
holds such a run scores 1 or more for that item.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 30
K1, B = 1.2, 0.75
#: Characters of test items in one index, which is broadcast: some ten bytes for each.
INDEX_CHARS = 16_000_000
BLOCK = 16
WINDOWS_AT_ONCE = 4096

_WORD = re.compile(rb"[a-z0-9_]+")
_ESCAPE = re.compile(rb"\\[nt]")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and underscores in lower case.

    The escapes ``\\n`` and ``\\t`` separate words.  Characters outside ASCII do too,
    also those whose lower case is an ASCII letter.
    """
    if not text:
        return []
    raw = text.encode("ascii", "replace")
    if b"\\" in raw:
        raw = _ESCAPE.sub(b" ", raw)
    return _WORD.findall(raw.lower())


def _run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n along the last axis."""
    x = ids.astype(np.uint64) + np.uint64(1)
    x ^= x << np.uint64(13)
    x *= _MULTIPLIER
    count = ids.shape[-1] - n + 1
    out = np.zeros((*ids.shape[:-1], count), np.uint64)
    for k in range(n):
        out *= np.uint64(1099511628211)
        out += x[..., k : k + count]
    return out


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position) of every element of many ranges."""
    owner = np.repeat(np.arange(len(start)), count)
    ends = np.cumsum(count)
    return owner, np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(start, count)


@dataclass
class LeakIndex:
    """Postings by term and block of items, with the maxima of both.

    Items are numbered in blocks of BLOCK.  ``cells`` are the pairs of a term and a block
    that have postings, in order: ``term * n_blocks + block``.
    """

    item_ids: np.ndarray  # of each item number
    vocabulary: dict[bytes, int]
    n_blocks: int
    cells: np.ndarray  # sorted; one more at the end that no term has
    cell_start: np.ndarray  # where each cell's postings begin, and their end
    cell_max: np.ndarray
    item: np.ndarray  # postings: item number
    weight: np.ndarray  # and weight
    term_max: np.ndarray  # terms + 1; the last is of no term
    words: np.ndarray  # the items' words, one item after the other
    run_hash: np.ndarray  # sorted hashes of all runs of min_words
    run_at: np.ndarray  # where in words each begins
    run_item: np.ndarray
    min_words: int

    @classmethod
    def build(cls, items: Sequence[tuple[int, str]], min_words: int = MIN_WORDS, k1: float = K1, b: float = B) -> "LeakIndex | None":
        """None when no item has ``min_words`` words, so that nothing can leak."""
        texts = [(i, w) for i, t in items if len(w := words(t)) >= min_words]
        if not texts:
            return None
        vocabulary: dict[bytes, int] = {}
        seqs = [np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], np.int32) for _, w in texts]
        n, v = len(seqs), len(vocabulary)
        length = np.array([len(s) for s in seqs])
        counted = [np.unique(s, return_inverse=True, return_counts=True) for s in seqs]
        df = np.bincount(np.concatenate([u for u, _, _ in counted]), minlength=v)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        weights = []
        for (u, place, tf), words_in in zip(counted, length):
            w = idf[u] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * words_in / length.mean()))
            runs = np.sort(np.lib.stride_tricks.sliding_window_view(place.reshape(-1), min_words), 1)
            fresh = np.ones_like(runs, bool)
            fresh[:, 1:] = runs[:, 1:] != runs[:, :-1]
            weights.append(w / (w[runs] * fresh).sum(1).min())
        term = np.concatenate([u for u, _, _ in counted]).astype(np.int64)
        item = np.repeat(np.arange(n), [len(u) for u, _, _ in counted])
        weight = np.concatenate(weights)
        order = np.lexsort((item, term))
        term, item, weight = term[order], item[order], weight[order]
        n_blocks = -(-n // BLOCK)
        cells, start = np.unique(term * n_blocks + item // BLOCK, return_index=True)
        term_max = np.zeros(v + 1)
        np.maximum.at(term_max, term, weight)
        offset = np.cumsum(length) - length
        h = [_run_hashes(s, min_words) for s in seqs]
        run_hash = np.concatenate(h)
        run_item = np.repeat(np.arange(n), [len(x) for x in h])
        run_at = np.concatenate([np.arange(len(x)) + o for x, o in zip(h, offset)])
        by = np.argsort(run_hash, kind="stable")
        return cls(
            np.array([i for i, _ in texts]), vocabulary, n_blocks, np.append(cells, (v + 1) * n_blocks), np.append(start, len(item)), np.maximum.reduceat(weight, start).astype(np.float32),
            item.astype(np.int32), weight.astype(np.float32), term_max.astype(np.float32), np.concatenate(seqs), run_hash[by], run_at[by], run_item[by].astype(np.int32), min_words,
        )

    def passages(self, text: str | None) -> np.ndarray:
        """Windows of twice ``min_words`` over the stretches of known words.

        A window begins every ``min_words + 1`` words, so each run of ``min_words`` lies
        whole in one of them.  Stretches shorter than a run can hold none.
        """
        n, none = self.min_words, len(self.vocabulary)
        found = words(text)
        if len(found) < n:
            return np.empty((0, 2 * n), np.int64)
        get = self.vocabulary.get
        ids = np.fromiter((get(x, none) for x in found), np.int64, len(found))
        known = np.concatenate(([0], (ids != none).view(np.int8), [0]))
        edge = np.diff(known)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        keep = end - begin >= n
        out = []
        for b, e in zip(begin[keep], end[keep]):
            starts = np.arange(b, max(b + 1, e - n + 1), n + 1)
            at = starts[:, None] + np.arange(2 * n)
            out.append(np.where(at < e, ids[np.minimum(at, e - 1)], none))
        return np.concatenate(out) if out else np.empty((0, 2 * n), np.int64)

    def retrieve(self, windows: np.ndarray, threshold: float = 1 - 1e-4) -> tuple[np.ndarray, np.ndarray]:
        """(window, item number) pairs that score at least ``threshold``.

        An item must hold a term that the window's weakest terms can't make up for: only
        those terms' blocks are candidates.  The maxima of all terms within a block then
        bound its score, and full scores are summed only for blocks that can still reach
        the threshold.
        """
        none, nb = len(self.vocabulary), self.n_blocks
        q = np.sort(windows, 1)
        q[:, 1:][q[:, 1:] == q[:, :-1]] = none  # a term counts once
        best = self.term_max[q]
        alive = np.flatnonzero(best.sum(1) >= threshold)
        w_out, i_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo in range(0, len(alive), 256):
            part = alive[lo : lo + 256]
            terms, tops = q[part], best[part]
            weakest = np.argsort(tops, 1, kind="stable")
            needed = np.zeros_like(tops, bool)
            np.put_along_axis(needed, weakest, np.cumsum(np.take_along_axis(tops, weakest, 1), 1) >= threshold, 1)
            needed &= terms != none
            row, col = np.nonzero(needed)
            t = terms[row, col]
            first, last = np.searchsorted(self.cells, t * nb), np.searchsorted(self.cells, (t + 1) * nb)
            owner, cell = _ranges(first, last - first)
            pairs = np.unique(row[owner] * nb + self.cells[cell] % nb)
            row, block = pairs // nb, pairs % nb
            for at in range(0, len(pairs), 4096):
                r, bl = row[at : at + 4096], block[at : at + 4096]
                wanted = terms[r] * nb + bl[:, None]
                place = np.searchsorted(self.cells, wanted)
                there = (self.cells[place] == wanted) & (terms[r] != none)
                bound = np.where(there, self.cell_max[np.minimum(place, len(self.cell_max) - 1)], 0).sum(1)
                keep = bound >= threshold
                r, bl, place, there = r[keep], bl[keep], place[keep], there[keep]
                pair, c = np.nonzero(there)
                cell = place[pair, c]
                owner, posting = _ranges(self.cell_start[cell], self.cell_start[cell + 1] - self.cell_start[cell])
                slot = pair[owner] * BLOCK + self.item[posting] % BLOCK
                scores = np.bincount(slot, self.weight[posting], len(r) * BLOCK).reshape(-1, BLOCK)
                p, i = np.nonzero(scores >= threshold)
                w_out.append(part[r[p]])
                i_out.append(bl[p] * BLOCK + i)
        return np.concatenate(w_out), np.concatenate(i_out)

    def verify(self, windows: np.ndarray, w: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Mask of the retrieved pairs whose passage holds a whole run of the item's words."""
        ok = np.zeros(len(w), bool)
        if not len(w):
            return ok
        n, items = self.min_words, len(self.item_ids)
        which, inverse = np.unique(w, return_inverse=True)
        h = _run_hashes(windows[which], n)
        first = np.searchsorted(self.run_hash, h)
        hit = self.run_hash[np.minimum(first, len(self.run_hash) - 1)] == h
        held = set()
        for r, c in zip(*np.nonzero(hit)):
            k, run = first[r, c], windows[which[r], c : c + n]
            while k < len(self.run_hash) and self.run_hash[k] == h[r, c]:
                if np.array_equal(self.words[self.run_at[k] : self.run_at[k] + n], run):
                    held.add(int(r) * items + int(self.run_item[k]))
                k += 1
        if held:
            ok = np.isin(inverse.reshape(-1) * items + i, np.fromiter(held, np.int64, len(held)))
        return ok

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, i = self.retrieve(windows)
        ok = self.verify(windows, w, i)
        return w[ok], self.item_ids[i[ok]]


def _indexed(items: DataFrame, chars: int) -> Iterator[list[tuple[int, str]]]:
    """Test items in groups of bounded size; one text longer than that is its own group."""
    part, size = [], 0
    for r in items.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        if part and size + len(r["text"]) > chars:
            yield part
            part, size = [], 0
        part.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if part:
        yield part


def leaked_items(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, index_chars: int = INDEX_CHARS) -> DataFrame:
    """``item_id, doc_id`` of each document with ``min_words`` consecutive words of an item.

    Null and empty texts, and items with fewer words, leak nothing; a repeated id counts
    once.  The items go to the tasks in an index of at most ``index_chars`` characters of
    text; a larger test set takes one pass over the documents for each such index.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("text is not null")
    schema = "item_id long, doc_id long"
    out = None
    for part in _indexed(items, index_chars):
        index = LeakIndex.build(part, min_words)
        if index is None:
            continue
        sent = spark.sparkContext.broadcast(index)

        def search(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ix = sent.value
            for batch in batches:
                doc_ids, found = batch.column(0).to_numpy(zero_copy_only=False), set()
                held, owner, n = [], [], 0

                def flush() -> None:
                    if held:
                        w, i = ix.find(np.concatenate(held))
                        found.update(zip(i.tolist(), np.concatenate(owner)[w].tolist()))
                        held.clear()
                        owner.clear()

                for d, text in zip(doc_ids, batch.column(1)):
                    p = ix.passages(text.as_py())
                    for lo in range(0, len(p), WINDOWS_AT_ONCE):
                        held.append(p[lo : lo + WINDOWS_AT_ONCE])
                        owner.append(np.full(len(held[-1]), d))
                        n += len(held[-1])
                        if n >= WINDOWS_AT_ONCE:
                            flush()
                            n = 0
                flush()
                pairs = sorted(found)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], names=["item_id", "doc_id"])

        hits = docs.mapInArrow(search, schema)
        out = hits if out is None else out.unionByName(hits)
    return (spark.createDataFrame([], schema) if out is None else out).distinct()


def leak_report(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """Each test item with the number of documents that leak it (0 included)."""
    n = leaks.groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.select("item_id", "suite").distinct().join(n, "item_id", "left").fillna(0, ["n_documents"])
