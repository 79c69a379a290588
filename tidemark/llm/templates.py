"""Benchmark decontamination by template canonicalisation.

Words are cut at white space, freed of ASCII punctuation and lower-cased; numbers, names (capitalised words that
do not begin a sentence or line) and units become typed placeholders. Windows of ``window`` such tokens of a
document are joined to the benchmark's windows on their hash; the hits of a document and an item that lie
on one diagonal are kept if their slots agree: each slot value of the item stands for one value in the document,
and different ones for different ones, the commonest pairs deciding. So a question whose numbers, names or units were replaced throughout is
caught, and a window that happens to have the same skeleton is not. A document holds an item if the consistent
hits cover at least ``min_share`` of the item's windows, of all or of those looked up by placeholders, or
if ``MIN_RUN`` words of it in a row are covered, whatever its length.

Both sides of the join are tables and neither is held by one task or the driver. Documents emit only windows that
pass a bit map of the benchmark's window hashes, at most ``MOST_BITS`` bits whatever the benchmark's size: with a
fuller map more windows pass, and the join decides. A window is sent with its own values, so texts are read once and
not shuffled. Hits are dealt by document and item, so a passage that is in many documents makes no large task.

Defined results: null or empty texts and items match nothing; items shorter than a window are one window;
a stretch of hits with fewer than ``min_literal`` words that are no placeholders counts only where its slots have
the item's own values, and windows with fewer than ``min_literal - 2`` are looked up by values; repeated rows give repeated result rows; a null id of a document or item is returned as null; empty tables give an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .textops import LOWER, mix, pack, prefix_hashes, slices, span_hashes, words

MOST_BITS = 1 << 27
#: Words of an item in a row that are enough, whatever their share of it.
MIN_RUN = 20
UNITS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces ton tons "
    "ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "cent cents dollar dollars euro euros percent degree degrees kmh mph watt watts volt volts joule joules newton newtons"
).split()
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))

_ALNUM = np.ones(256, bool)
_ALNUM[:128] = [chr(i).isalnum() for i in range(128)]
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True


def _plain_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    kept = np.where(_ALNUM[data], LOWER[data], 0).astype(np.uint8)
    out = prefix_hashes(kept)
    # bytes of punctuation count nothing: take away what the zero byte would add
    zero = prefix_hashes(np.zeros(len(data), np.uint8))
    skip = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(np.where(_ALNUM[data], np.uint64(0), np.diff(zero)), out=skip[1:])
    h = span_hashes(out - skip, start, end)
    for i in np.flatnonzero(end - start > 64):  # long spans can share a polynomial
        h[i] = xxhash.xxh3_64_intdigest(kept[start[i] : end[i]].tobytes().replace(b"\0", b""))
    return h


def tokens(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Template tokens, their own values, and where each text's tokens start (with the end as last)."""
    data, at = pack(texts)
    start, end, first = words(data, at)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    following = np.where(_ALNUM[data], np.arange(len(data)), len(data))
    following = np.minimum.accumulate(following[::-1])[::-1]
    begin = following[start]
    real = begin < end
    ends_sentence = _STOP[data[end - 1]]
    opens = np.ones(len(start), bool)
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    opens[1:] = ends_sentence[:-1] | (breaks[start[1:]] > breaks[end[:-1]])
    digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    begin, end, opens = begin[real], end[real], opens[real]
    value = _plain_hash(data, begin, end)
    token = value.copy()
    token[np.isin(value, _unit_hashes())] = UNIT
    token[_UPPER[data[begin]] & ~opens] = NAME
    token[digits[end] > digits[begin]] = NUMBER
    kept_before = np.concatenate(([0], np.cumsum(real)))
    return token, value, kept_before[first]


_units: np.ndarray | None = None


def _unit_hashes() -> np.ndarray:
    global _units
    if _units is None:
        data, at = pack(UNITS)
        start, end, _ = words(data, at)
        _units = np.sort(_plain_hash(data, start, end))
    return _units


def _is_slot(token: np.ndarray) -> np.ndarray:
    return (token == NUMBER) | (token == NAME) | (token == UNIT)


def _windows(token: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of windows that lie within one text, and where each starts."""
    n = len(token) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h += token[j : j + n] * np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64))
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = np.flatnonzero(text[:n] == text[size - 1 : size - 1 + n])
    return mix(h[whole]), whole


def _key(h: np.ndarray, size: int, by_value: bool) -> np.ndarray:
    return mix(h + np.uint64(2 * size + by_value))


def _cells(x: np.ndarray, start: np.ndarray, size: int) -> list[bytes]:
    """The window's part of an array for each start."""
    return [row.tobytes() for row in x[start[:, None] + np.arange(size)]]


_BOOK = "h long, item long, item_id long, size int, by_value boolean, at int, token binary, value binary, windows int, typed int, is_typed boolean"


def book_of(items: pd.DataFrame, window: int, min_literal: int) -> Iterator[pd.DataFrame]:
    """Rows of the benchmark's windows; ``windows`` and ``typed``: how many the item has, and how many looked up by placeholders."""
    token, value, first = tokens(items["text"])
    length = np.diff(first)
    literal = np.concatenate(([0], np.cumsum(~_is_slot(token))))
    item_of = np.repeat(np.arange(len(items)), length)
    counts, typed, found = np.zeros(len(items), np.int64), np.zeros(len(items), np.int64), []
    for size in sorted({min(window, int(n)) for n in length if n}):
        for by_value in (False, True):
            h, start = _windows(value if by_value else token, first, size)
            fits = np.minimum(length[item_of[start]], window) == size
            enough = literal[start + size] - literal[start] >= min_literal - 2
            if by_value:  # few windows may all begin with a word that is a name in one text and not in the other
                fits &= ~enough | (length[item_of[start]] <= 2 * window)
            else:
                counts += np.bincount(item_of[start[fits]], minlength=len(items))
                fits &= enough
                typed += np.bincount(item_of[start[fits]], minlength=len(items))
            found.append((size, by_value, _key(h[fits], size, by_value), start[fits], enough[fits]))
    ids, item = items["item_id"].astype("Int64").array, items["item"].to_numpy()
    for size, by_value, h, start, enough in found:
        of = item_of[start]
        yield pd.DataFrame({"h": h.view(np.int64), "item": item[of], "item_id": ids[of], "size": size, "by_value": by_value, "at": start - first[of], "token": _cells(token, start, size), "value": _cells(value, start, size), "windows": counts[of], "typed": typed[of], "is_typed": enough})


def _consistent(mine: np.ndarray, theirs: np.ndarray, kind: np.ndarray) -> bool:
    """Whether item values and document values of slots stand for each other one to one."""
    pairs = set(zip(kind.tolist(), mine.tolist(), theirs.tolist(), strict=True))
    return len({(k, a) for k, a, _ in pairs}) == len(pairs) == len({(k, b) for k, _, b in pairs})


def _judged(rows: pd.DataFrame, min_literal: int, min_share: float) -> tuple[int, bool] | None:
    """(hits, whether all slots are equal) if these hits of one document and item, sorted by size, shift and place, say that it holds it."""
    good_at, exact, long = set(), True, False
    size_, shift_ = rows["size"].to_numpy(), rows["shift"].to_numpy()
    cut = np.flatnonzero((np.diff(size_) != 0) | (np.diff(shift_) != 0)) + 1
    for a, z in zip([0, *cut], [*cut, len(rows)], strict=True):
        part, size = rows.iloc[a:z], int(size_[a])
        at = part["at"].to_numpy()
        base = int(at[0])
        cells = at[:, None] - base + np.arange(size)
        of = lambda c: np.frombuffer(b"".join(part[c]), np.uint64).reshape(-1, size)  # noqa: E731, B023
        token, mine, theirs = (np.zeros(int(at[-1]) - base + size, np.uint64) for _ in range(3))
        token[cells], mine[cells], theirs[cells] = of("token"), of("value"), of("own")
        starts = np.unique(at) - base
        slot = np.unique(cells)
        slot = slot[_is_slot(token[slot])]
        same = mine[slot] == theirs[slot]
        good = starts
        if not same.all() and not _consistent(mine[slot], theirs[slot], token[slot]):
            agrees = np.ones(len(token), bool)
            agrees[slot] = _agreeing(mine[slot], theirs[slot], token[slot])
            good = starts[agrees[starts[:, None] + np.arange(size)].all(axis=1)]
        good = _with_evidence(token, good, size, slot[~same], min_literal)
        if len(good):
            runs = np.split(good, np.flatnonzero(np.diff(good) > 1) + 1)
            long |= max(int(x[-1] - x[0]) for x in runs) + size >= MIN_RUN
            good_at.update((good + base).tolist())
            exact &= bool(same.all())
    if not good_at:
        return None
    typed = len(good_at & set(rows["at"][rows["is_typed"]]))
    whole = len(good_at) >= min_share * rows["windows"].iloc[0] or (typed > 0 and typed >= min_share * rows["typed"].iloc[0])
    return (len(good_at), exact) if long or whole else None


def _with_evidence(token: np.ndarray, starts: np.ndarray, size: int, changed: np.ndarray, min_literal: int) -> np.ndarray:
    """Windows in stretches with enough literals, and of others those without a changed slot."""
    kept = [np.zeros(0, np.int64)]
    for stretch in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
        if len(stretch) and (~_is_slot(token[stretch[0] : stretch[-1] + size])).sum() < min_literal:
            stretch = stretch[np.searchsorted(changed, stretch) == np.searchsorted(changed, stretch + size)]
        kept.append(stretch)
    return np.concatenate(kept)


def _agreeing(mine: np.ndarray, theirs: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Which slots agree with a one-to-one reading: commonest pairs first, of equally common ones the earliest."""
    pairs = list(zip(kind.tolist(), mine.tolist(), theirs.tolist(), strict=True))
    there: dict[tuple[int, int], int] = {}
    back: dict[tuple[int, int], int] = {}
    taken = set()
    for (k, a, b), _ in Counter(pairs).most_common():  # equal counts in the order of first places
        if (k, a) not in there and (k, b) not in back:
            there[k, a], back[k, b] = b, a
            taken.add((k, a, b))
    return np.array([x in taken for x in pairs])


def _bit_map(book: DataFrame) -> np.ndarray:
    """Bits of the window hashes, sixteen for each or at most ``MOST_BITS``."""
    bits = 64
    while bits < min(MOST_BITS, 16 * book.count()):
        bits *= 2
    place = F.col("h").bitwiseAND(F.lit(bits - 1).cast("long"))
    words = book.select((place / 64).cast("int").alias("i"), F.expr("shiftleft(1L, cast(h & 63L as int))").alias("w")).groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["i"].to_numpy()] = words["w"].to_numpy().view(np.uint64)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, spark: SparkSession, window: int = 8, min_literal: int = 5, min_share: float = 0.3, id_col: str = "doc_id") -> DataFrame:
    """(id, item_id, hits, windows, exact): one row for each document and item that it holds."""
    scratch = Scratch(spark)
    items = scratch.put(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("length(text) > 0").withColumn("item", F.monotonically_increasing_id()), "items")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in slices(batch):
                yield from book_of(part, window, min_literal)

    book = scratch.put(items.mapInPandas(cut, _BOOK), "book")
    kinds = [tuple(r) for r in book.select("size", "by_value").distinct().collect()]  # two for each size up to ``window``
    sent = spark.sparkContext.broadcast(_bit_map(book))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, base = sent.value, TaskContext.get().partitionId() << 32  # a number for each row read
        top = np.uint64(len(bits) - 1)
        for batch in batches:
            for part in slices(batch):
                token, value, first = tokens(part["text"])
                text_of = np.repeat(np.arange(len(part)), np.diff(first))
                ids = part["id"].astype("Int64").array
                for size, by_value in kinds:
                    h, start = _windows(value if by_value else token, first, size)
                    h = _key(h, size, by_value)
                    hit = np.flatnonzero(bits[h >> np.uint64(6) & top] >> (h & np.uint64(63)) & np.uint64(1))
                    start, of = start[hit], text_of[start[hit]]
                    yield pd.DataFrame({"row": base + of, "id": ids[of], "h": h[hit].view(np.int64), "pos": start - first[of], "own": _cells(value, start, size)})
                base += len(part)

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    hits = narrow.mapInPandas(find, "row long, id long, h long, pos int, own binary")
    met = hits.join(book, "h").withColumn("shift", F.col("pos") - F.col("at")).drop("h", "pos", "by_value")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by document and item; the last of them waits for the next batch."""
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch])
            edge = [0, *(np.flatnonzero((np.diff(rest["row"].to_numpy()) != 0) | (np.diff(rest["item"].to_numpy()) != 0)) + 1)]
            yield of([rest.iloc[a:z] for a, z in zip(edge, edge[1:], strict=False)])
            rest = rest.iloc[edge[-1] :]
        if rest is not None and len(rest):
            yield of([rest])

    def of(groups: list[pd.DataFrame]) -> pd.DataFrame:
        out = []
        for g in groups:
            if (got := _judged(g, min_literal, min_share)) is not None:
                out.append([g["id"].iloc[0], g["item_id"].iloc[0], got[0], g["windows"].iloc[0], got[1]])
        frame = pd.DataFrame(out, columns=["id", "item_id", "hits", "windows", "exact"])
        return frame.assign(id=frame["id"].astype("Int64"), item_id=frame["item_id"].astype("Int64"), exact=frame["exact"].astype(bool))

    dealt = met.repartition("row", "item").sortWithinPartitions("row", "item", "size", "shift", "at")
    return dealt.mapInPandas(judge, "id long, item_id long, hits long, windows long, exact boolean")


def op7_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spark).withColumnRenamed("id", "doc_id")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that hold a benchmark item go; rows without an id stay.

    Further columns are kept as they are, whatever their names; an empty table stays empty, and with an empty
    benchmark all rows stay.
    """
    # written, so that its size decides how it is joined
    gone = Scratch(spark).put(contaminated(docs, table(spark, sf_dir, "benchmark"), spark).select(F.col("id").alias("doc_id")).distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti")
