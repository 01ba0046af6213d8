"""Fill-in-middle transformation with cut points found in indexable skip lists.

A text is a sequence of units: a word with the white space before it, or white space alone at the end.
Two cuts at unit ranks make prefix, middle and suffix; the parts are put out with sentinels in the
order prefix-suffix-middle (`psm`) or suffix-prefix-middle (`spm`), or the text stays `plain`.

Each text has an indexable skip list of its units. The links of a lane carry how many units and how
many code points they span; lane 0 links neighbours, and each lane above keeps about a quarter of
the nodes, its widths being sums of widths below. A search starts at the head of the top lane, goes
right while the rank is not passed, adding up both widths, and then descends; it ends at the rank
itself, and the sum of code points is the place of the cut. The lists of all texts of a slice are
arrays, and all searches of a slice go down together.

Null and empty texts have no unit and stay plain, as does a text that holds a sentinel. A null key is
hashed as an empty string. Rows that share a key are cut by the same numbers. The cost of a row is
linear in its text; no row needs another one, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.llm import words
from postsift.llm.common import give_back, mix, row_slices, seeded, text_buffer

SENTINELS = ("<P>", "<S>", "<M>")
#: A lane keeps about one of 2^LANE_BITS nodes of the lane below.
LANE_BITS = 2
#: The top lane has no more links than this in any list.
TOP_LINKS = 4

#: Bytes of text cut by one run of array operations; their arrays take some eighty bytes for each of them.
SLICE_BYTES = 250_000

_HEIGHT_SEED = seeded("skip list", 1)[0]


class SkipLists:
    """Skip lists of many sequences; `counts` nodes each, node i spanning `widths[i]` code points."""

    def __init__(self, counts: np.ndarray, widths: np.ndarray) -> None:
        first = np.concatenate(([0], np.cumsum(counts)))
        place = np.arange(first[-1]) - np.repeat(first[:-1], counts)
        coin = mix(place.astype(np.uint64) + _HEIGHT_SEED)
        units, chars = np.ones(len(place), np.int64), np.asarray(widths, np.int64)
        #: Of each lane: offsets of the links of each list, both widths, and the place below of each link's end.
        self.lanes = [(first, units, chars, None)]
        while len(units) and np.diff(first).max() > TOP_LINKS:
            up = (coin & np.uint64((1 << LANE_BITS) - 1)) == 0
            coin = coin[up] >> np.uint64(LANE_BITS)
            ends = np.flatnonzero(up)
            owner = np.searchsorted(first, ends, "right") - 1
            # A link of the new lane spans what lies behind the kept node before it, or the head.
            behind = np.where(np.concatenate(([True], owner[1:] != owner[:-1])), first[owner], np.concatenate(([0], ends[:-1] + 1))) if len(ends) else ends
            wide = [np.concatenate(([0], np.cumsum(w))) for w in (units, chars)]
            units, chars = (w[ends + 1] - w[behind] for w in wide)
            below = ends - first[owner] + 1
            first = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(counts)))))
            self.lanes.append((first, units, chars, below))

    def descend(self, lists: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Code points before the given unit rank of each given list; a rank is at most the list's length."""
        at, left, passed = np.zeros(len(lists), np.int64), np.array(ranks, np.int64), np.zeros(len(lists), np.int64)
        for first, units, chars, below in reversed(self.lanes):
            going = np.arange(len(lists))
            while len(going):
                link = first[lists[going]] + at[going]
                there = link < first[lists[going] + 1]
                going, link = going[there], link[there]
                right = units[link] <= left[going]
                going, link = going[right], link[right]
                left[going] -= units[link]
                passed[going] += chars[link]
                at[going] += 1
            if below is not None:  # the same node one lane down; the head stays the head
                inside = at > 0
                at[inside] = below[first[lists[inside]] + at[inside] - 1]
        return passed


def _hashes(key: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _slice(data: np.ndarray, offsets: np.ndarray, h: list[np.ndarray], rate: int, spm: int, marks: list[bytes]):
    """n, form, code points of prefix and middle, and output bytes of each row of a slice."""
    rows = len(offsets) - 1
    starts, ends, owner = words.spans(data, offsets)
    sizes = np.diff(offsets)
    trailing = np.zeros(rows, bool)
    full = sizes > 0
    trailing[full] = words._SPACE[data[offsets[1:][full] - 1]]
    n = np.bincount(owner, minlength=rows) + trailing
    # Unit ends in text order: ends of words, and the end of a text that ends in white space.
    stops = np.sort(np.concatenate([ends, offsets[1:][trailing]]))
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    begin = np.concatenate(([0], stops[:-1])) if len(stops) else stops
    lists = SkipLists(n, points[stops] - points[begin])
    cuts = [np.minimum(h[0] % (n + 1), h[1] % (n + 1)), np.maximum(h[0] % (n + 1), h[1] % (n + 1))]
    every = np.arange(rows)
    first, second = (lists.descend(every, cut) for cut in cuts)
    lead = np.append(lead, len(data))
    at = [np.minimum(lead[np.minimum(points[offsets[:-1]] + c, len(lead) - 1)], offsets[1:]) for c in (first, second)]
    whole = data.tobytes()
    forms, outputs = [], []
    p, s, m = marks
    for i in range(rows):
        a, x, y, b = int(offsets[i]), int(at[0][i]), int(at[1][i]), int(offsets[i + 1])
        text = whole[a:b]
        if not text or h[2][i] % 100 >= rate or any(mark in text for mark in marks):
            forms.append("plain")
            outputs.append(text)
        elif h[3][i] % 100 < spm:
            forms.append("spm")
            outputs.append(b"".join((s, whole[y:b], p, whole[a:x], m, whole[x:y])))
        else:
            forms.append("psm")
            outputs.append(b"".join((p, whole[a:x], s, whole[y:b], m, whole[x:y])))
    plain = np.array([f == "plain" for f in forms], bool)
    return n, forms, np.ma.array(first, mask=plain), np.ma.array(second - first, mask=plain), outputs


def _cut(batches: Iterator[pa.RecordBatch], rate: int, spm: int, marks: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Output rows of batches of key, text and four hashes; a batch's memory goes back before the next one is read."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(1))
        h = [np.asarray(batch.column(2 + i).to_numpy(zero_copy_only=False), np.int64) for i in range(4)]
        for a, b in row_slices(offsets, SLICE_BYTES):
            n, forms, prefix, middle, out = _slice(
                data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], [x[a:b] for x in h], rate, spm, marks
            )
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(forms, pa.string()),
                *(pa.array(x.data, pa.int64(), mask=np.ma.getmaskarray(x)) for x in (prefix, middle)),
                pa.array(out, pa.binary()).view(pa.string()),
            ], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
            del n, forms, prefix, middle, out
        del data, offsets, h, batch
        give_back(cycles=False)


def transform(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80,
    sentinels: tuple[str, str, str] = SENTINELS,
) -> DataFrame:
    """doc_id, n units, form, prefix_chars, middle_chars (null if plain), output: one row per row of `docs`.

    `rate` percent of the texts are transformed, `spm` percent of those to suffix-prefix-middle."""
    marks = [s.encode() for s in sentinels]
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("t"), *_hashes(docs[key], seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut(batches, rate, spm, marks)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from which `output` was made."""
    pattern = "|".join(r"\Q" + s + r"\E" for s in sentinels)
    parts = F.array(F.split(output, pattern, -1))  # an array, so that the split is made once
    psm = F.transform(parts, lambda x: F.concat(x[1], x[3], x[2]))[0]
    spm = F.transform(parts, lambda x: F.concat(x[2], x[3], x[1]))[0]
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
