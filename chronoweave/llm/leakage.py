"""Evaluation texts leaking into training text.

Q-gram lemma filtering: texts are reduced to their letters and digits; q-grams shared
by a document and an item are counted in overlapping diagonal bands, regions
that meet the edit-budget bound are kept, and a banded word alignment verifies them.

Items are a table of q-grams. A map of fixed size says which q-grams
may be an item's; stretches of a document that are dense enough in them
for the shortest passage of some class of items go on. They meet the items' q-grams in a broadcast table if these are few,
else in a join, with the same result. Only documents with such a region are read again, for the alignment.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.session import materialize

Q = 7
#: Longer words stand in the q-grams as a beginning and a hash of this length in all, so no edit moves a diagonal further.
LONGEST = 16
_DROP = re.compile(r"[^\w\s]+|_+")
_LONG = re.compile(rf"\w{{{LONGEST + 1},}}")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MAP_BITS = 22
#: Up to so many q-grams of items are broadcast.
TABLE_GRAMS = 2_000_000


def words_of(text: str) -> list[str]:
    """Words by their letters and digits alone, in lower case."""
    return _DROP.sub("", text.lower()).split()


def _short(word: str) -> str:
    return word if len(word) <= LONGEST else word[: LONGEST - 8] + f"{xxhash.xxh32_intdigest(word):08x}"


def _joined(text: str) -> str:
    """The text's words without blanks, long ones shortened."""
    clean = _DROP.sub("", text.lower())
    return "".join(map(_short, clean.split()) if _LONG.search(clean) else clean.split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "uint32")


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, "uint64")
    h = np.zeros(n, "uint64")
    for i in range(Q):
        h = (h ^ codes[i : i + n]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def bounds(words: list[str], min_share: float, edits: float) -> tuple[int, int, int, int]:
    """(least words, shared q-grams that a passage within the budget must have, characters of a document it covers at most, half a band)."""
    m = max(1, int(np.ceil(min_share * len(words) - 1e-9)))
    e = int(np.floor(edits * m + 1e-9))
    sizes = np.array([min(len(w), LONGEST) for w in words])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    lengths = begin[m:] - begin[:-m]
    widest = int(np.sort(sizes)[::-1][:e].sum()) if e else 0
    return m, max(1, int(lengths.min()) - Q + 1 - widest - e * (Q - 1)), int(lengths.max()) + LONGEST * e + Q, LONGEST * max(1, e)


ITEMS = "item_id bigint, text string, least int, need int, span int, half int, class int"


def _items(items: DataFrame, min_share: float, edits: float) -> DataFrame:
    """The items with their bounds; class is the power of two of the least number of words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                if w := words_of(text):
                    least, need, span, half = bounds(w, min_share, edits)
                    rows.append((item, text, least, need, span, half, least.bit_length()))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ITEMS.split(", ")])

    usable = items.where("item_id IS NOT NULL AND length(text) > 0").select(F.col("item_id").cast("bigint").alias("item_id"), "text").groupBy("item_id").agg(F.min("text").alias("text"))
    return usable.mapInPandas(run, ITEMS)


def _item_grams(items: DataFrame) -> DataFrame:
    """(gram, item_id, place, class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text, cls in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), batch.column("class").to_pylist()):
                h = _grams(_codes(_joined(text))).view("int64")
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), item)), pa.array(np.arange(len(h), dtype="int32")), pa.array(np.full(len(h), cls, "int32"))], names=["gram", "item_id", "place", "class"])

    return items.select("item_id", "text", "class").mapInArrow(run, "gram bigint, item_id bigint, place int, class int")


def _dense(documents: DataFrame, known: np.ndarray, classes: list[tuple[int, int, int]], table: tuple[np.ndarray, ...] | None = None, chars: int = 1_000_000) -> DataFrame:
    """(gram, doc_id, version, pos): the q-grams of the stretches that may hold a passage of some class (class, least need, greatest span).

    With a table (grams in order, item and place of each; item_id, need, span and half of the items) the regions themselves, REGIONS.
    """
    handle = documents.sparkSession.sparkContext.broadcast((known, table))  # of fixed size, and TABLE_GRAMS rows at most

    def meet(gram: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, versions: np.ndarray, table: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        grams, owner, place, item_id, need, span, half = table
        first, last = np.searchsorted(grams, gram, "left"), np.searchsorted(grams, gram, "right")
        n = last - first
        at = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pair = np.repeat(doc, n) * len(item_id) + owner[at]
        if len(ids) * len(item_id) <= 50_000_000:
            enough = (np.bincount(pair, minlength=len(ids) * len(item_id)) >= np.tile(need, len(ids)))[pair]
        else:
            kinds, back, count = np.unique(pair, return_inverse=True, return_counts=True)
            enough = (count >= need[kinds % len(item_id)])[back]
        own, at = np.repeat(np.arange(len(gram)), n)[enough], at[enough]
        d, p, o = doc[own], pos[own], owner[at]
        rows = [pd.DataFrame({"doc": d, "item": o, "shift": shift, "band": (p - place[at] + shift * half[o]) // (2 * half[o]), "pos": p}) for shift in (0, 1)]
        t = pd.concat(rows, ignore_index=True).drop_duplicates().sort_values(["doc", "item", "shift", "band", "pos"], ignore_index=True)
        o, d = t.pop("item").to_numpy(), t.pop("doc").to_numpy()
        t = t.assign(doc_id=ids[d], version=versions[d], item_id=item_id[o], need=need[o], span=span[o], half=half[o])
        return pa.RecordBatch.from_pandas(_region_rows(t), preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = handle.value

        def part(ids: list, versions: list, texts: list[str]) -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts])
            doc = np.repeat(np.arange(len(texts)), lengths)
            start = np.cumsum(lengths) - lengths
            h = _grams(_codes("".join(texts)))
            cls = known[(h >> np.uint64(64 - MAP_BITS)).astype("int64")]
            at = np.flatnonzero(cls)
            at = at[at + Q <= (start + lengths)[doc[at]]]  # no q-gram reaches into the next text
            keep = np.zeros(len(at), bool)
            for c, need, span in classes:
                own = np.flatnonzero(cls[at] >> np.uint64(c) & np.uint64(1))
                p = at[own]
                if len(p) < need:
                    continue
                ahead = np.arange(need - 1, len(p))
                first = np.arange(len(ahead))
                good = (doc[p[ahead]] == doc[p[first]]) & (p[ahead] - p[first] <= span)
                change = np.zeros(len(p) + 1, "int64")
                change[first[good]] += 1
                change[ahead[good] + 1] -= 1
                keep[own[np.cumsum(change[:-1]) > 0]] = True
            at = at[keep]
            d = doc[at]
            if table is not None:
                return meet(h[at].view("int64"), d, at - start[d], np.array(ids, "int64"), np.array(versions, "int64"), table)
            return pa.RecordBatch.from_arrays([pa.array(h[at].view("int64")), pa.array(np.array(ids, "int64")[d]), pa.array(np.array(versions, "int64")[d]), pa.array((at - start[d]).astype("int64"))], names=["gram", "doc_id", "version", "pos"])

        for batch in batches:
            ids, versions, texts, size = [], [], [], 0
            for i, v, t in zip(batch.column("doc_id").to_pylist(), batch.column("version").to_pylist(), batch.column("text")):
                ids.append(i)
                versions.append(v)
                texts.append(_joined(t.as_py()))
                size += len(texts[-1])
                if size > chars:
                    yield part(ids, versions, texts)
                    ids, versions, texts, size = [], [], [], 0
            if size:
                yield part(ids, versions, texts)

    return documents.mapInArrow(run, REGIONS if table is not None else "gram bigint, doc_id bigint, version bigint, pos bigint")


REGIONS = "doc_id bigint, version bigint, item_id bigint, diagonal bigint, low bigint, high bigint"
BAND = ["doc_id", "version", "item_id", "shift", "band"]


def _region_rows(t: pd.DataFrame) -> pd.DataFrame:
    """REGIONS of whole bands, whose rows are sorted by (*BAND, pos), each once: the stretches that meet the q-gram bound."""
    if not len(t):
        return pd.DataFrame({c.split()[0]: pd.Series([], dtype="int64") for c in REGIONS.split(", ")})
    cols = [t[k].to_numpy() for k in BAND]
    new = np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0))
    k, p = np.cumsum(new), t["pos"].to_numpy()
    need, span = t["need"].to_numpy(), t["span"].to_numpy()
    ahead = np.arange(len(k)) + need - 1
    inside = ahead < len(k)
    ahead = np.minimum(ahead, len(k) - 1)
    g = np.flatnonzero(inside & (k[ahead] == k) & (p[ahead] - p <= span))
    if not len(g):
        return _region_rows(t.iloc[:0])
    kk, low, high = k[g], p[g], p[ahead[g]] + Q
    base = kk * (int(high.max()) + 1)  # so that a running maximum begins anew with each band
    cut = np.flatnonzero((kk[1:] != kk[:-1]) | (low[1:] + base[1:] > np.maximum.accumulate(high + base)[:-1])) + 1
    a = np.append(0, cut)
    rows, half = t.iloc[g[a]], t["half"].to_numpy()[g[a]].astype("int64")
    return pd.DataFrame({
        "doc_id": rows["doc_id"].to_numpy(), "version": rows["version"].to_numpy(), "item_id": rows["item_id"].to_numpy(),
        "diagonal": rows["band"].to_numpy() * 2 * half - rows["shift"].to_numpy() * half, "low": low[a], "high": np.maximum.reduceat(high, a),
    })


def _regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """REGIONS of rows sorted by (*BAND, pos). A band that a batch cuts is carried on."""
    kept: pd.DataFrame | None = None
    for batch in batches:
        if batch.empty:
            continue
        t = pd.concat([kept, batch], ignore_index=True) if kept is not None else batch
        last = t[BAND].to_numpy()
        same = (last == last[-1]).all(axis=1)
        cut = len(t) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield _region_rows(t.iloc[:cut])
        kept = t.iloc[cut:]
    if kept is not None and len(kept):
        yield _region_rows(kept)


def align(item: list[int], doc: list[int], centre: int, width: int) -> list[tuple[int, int, bool]]:
    """Best local alignment within a band: (item word or -1, doc word or -1, equal) along its path. Only the band is held."""
    n, m = len(item), len(doc)
    wide = 2 * width + 1
    # score[i][j - i - centre + width] is that of item words up to i and doc words up to j
    score = [[0] * (wide + 2) for _ in range(n + 1)]
    best, end = 0, (0, 0)
    for i in range(1, n + 1):
        row, up, x = score[i], score[i - 1], item[i - 1]
        left = i + centre - width
        for c in range(max(0, 1 - left), min(wide, m - left + 1)):
            s = up[c] + (2 if x == doc[left + c - 1] else -1)
            if up[c + 1] - 1 > s:
                s = up[c + 1] - 1
            if c and row[c - 1] - 1 > s:
                s = row[c - 1] - 1
            if s > 0:
                row[c] = s
                if s > best:
                    best, end = s, (i, left + c)
    i, j = end
    path = []
    while i and j:
        c = j - i - centre + width
        if not 0 <= c < wide or score[i][c] <= 0:
            break
        same = item[i - 1] == doc[j - 1]
        if score[i][c] == score[i - 1][c] + (2 if same else -1):
            path.append((i - 1, j - 1, same))
            i, j = i - 1, j - 1
        elif score[i][c] == score[i - 1][c + 1] - 1:
            path.append((i - 1, -1, False))
            i -= 1
        else:
            path.append((-1, j - 1, False))
            j -= 1
    return path[::-1]


def longest_passage(path: list[tuple[int, int, bool]], edits: float) -> tuple[int, int, int, int, int]:
    """(item words, differing words, item from, doc from, doc to) of the longest stretch within the edit budget."""
    best = (0, 0, 0, 0, 0)
    for a in range(len(path)):
        if not path[a][2]:
            continue
        length = wrong = 0
        for b in range(a, len(path)):
            i, _, same = path[b]
            length += i >= 0
            wrong += not same
            if same and length > best[0] and wrong <= edits * length + 1e-9:
                best = (length, wrong, path[a][0], path[a][1], path[b][1] + 1)
        if len(path) - a <= best[0]:
            break
    return best


RESULT = "doc_id bigint, item_id bigint, words int, differing int, item_words int, item_from int, doc_from int, doc_to int"


def _verified(edits: float):
    def starts(words: list[str]) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([min(len(w), LONGEST) for w in words])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                own, words = words_of(r.item_text), words_of(r.text)
                at_item, begin = starts(own), starts(words)
                reach = 2 * r.half + int(at_item[-1])
                a = max(0, int(np.searchsorted(begin, max(0, r.low - reach), "right")) - 1)
                b = int(np.searchsorted(begin, min(begin[-1], r.high + reach), "left"))
                # The band in words about the place where the region's characters lie.
                mid_doc = int(np.searchsorted(begin, r.low, "right")) - 1
                mid_item = int(np.searchsorted(at_item, max(0, r.low - (r.diagonal + r.half)), "right")) - 1
                number: dict[str, int] = {}
                path = align([number.setdefault(w, len(number)) for w in own], [number.get(w, -1) for w in words[a:b]], mid_doc - a - mid_item, 8 + r.half // 2)
                p = longest_passage(path, edits)
                if p[0] >= r.least:
                    rows.append((r.doc_id, r.item_id, p[0], p[1], len(own), p[2], p[3] + a, p[4] + a))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return run


def leaks(documents: DataFrame, items: DataFrame, min_share: float = 0.4, edits: float = 0.1) -> DataFrame:
    """A row for each document and item of which it holds a passage: (doc_id, item_id, words, differing, item_words, item_from, doc_from, doc_to).

    A passage is unbroken, has at least min_share of the item's words in order, and
    up to ``edits`` of them may differ; of several the longest is given (then the first), its place in words. Words are compared by
    letters and digits alone, in any case. Null or empty texts hold nothing; a repeated
    doc_id is judged by each of its texts; of a repeated item_id the smallest text counts; items without words, or of fewer than Q characters, never occur.
    """
    spark = documents.sparkSession
    held = materialize(_items(items, min_share, edits), "items")
    grams = materialize(_item_grams(held), "item_grams")
    classes = [(r["class"], r["need"], r["span"]) for r in held.groupBy("class").agg(F.min("need").alias("need"), F.max("span").alias("span")).orderBy("class").collect()]  # a row a power of two
    if not classes:
        return spark.createDataFrame([], RESULT)
    flags = grams.groupBy(F.shiftrightunsigned("gram", 64 - MAP_BITS).cast("int").alias("b")).agg(F.bit_or(F.expr("shiftleft(1L, class)")).alias("c")).toArrow()
    known = np.zeros(1 << MAP_BITS, "uint64" if classes[-1][0] > 31 else "uint32")
    known[flags.column("b").to_numpy()] = flags.column("c").to_numpy().astype(known.dtype)
    docs = documents.where("doc_id IS NOT NULL AND length(text) > 0").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("version"), "text")
    numbers = held.select("item_id", "need", "span", "half")
    if grams.count() <= TABLE_GRAMS:
        order = grams.orderBy("gram", "item_id", "place").toArrow()  # its size was checked
        items_ = numbers.orderBy("item_id").toArrow()
        column = lambda t, c: t.column(c).to_numpy()
        table = (column(order, "gram"), np.searchsorted(column(items_, "item_id"), column(order, "item_id")), column(order, "place").astype("int64"), *(column(items_, c).astype("int64") for c in ("item_id", "need", "span", "half")))
        found = materialize(_dense(spread(docs), known, classes, table), "regions")
    else:
        found = materialize(_joined_regions(materialize(_dense(spread(docs), known, classes), "dense"), grams.drop("class"), numbers), "regions")
    texts = docs.join(found.select("doc_id", "version").distinct(), ["doc_id", "version"], "left_semi").dropDuplicates(["doc_id", "version"])
    pairs = found.join(held.select("item_id", "least", "half", F.col("text").alias("item_text")), "item_id").join(texts, ["doc_id", "version"])
    passages = pairs.repartition("doc_id", "item_id").mapInPandas(_verified(edits), RESULT)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("words"), "differing", "doc_from", "item_from", "doc_to")
    return passages.withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def _joined_regions(likely: DataFrame, grams: DataFrame, numbers: DataFrame) -> DataFrame:
    # First how many q-grams a document and an item share anywhere: counted before any shuffle, and few pairs have enough.
    shared = likely.join(grams.select("gram", "item_id"), "gram").groupBy("doc_id", "version", "item_id").agg(F.count("*").alias("n"))
    enough = materialize(shared.join(numbers, "item_id").where("n >= need").drop("n"), "enough")
    met = likely.join(enough, ["doc_id", "version"]).join(grams, ["gram", "item_id"])
    banded = met.withColumn("shift", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", F.floor((F.col("pos") - F.col("place") + F.col("shift") * F.col("half")) / (2 * F.col("half"))))
    once = banded.select(*BAND, "pos", "need", "span", "half").distinct()
    return once.repartition("doc_id", "version", "item_id").sortWithinPartitions(*BAND, "pos").mapInPandas(_regions, REGIONS)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores, where a few files would leave most of them idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df
