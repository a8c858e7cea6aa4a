"""Subject areas of documents, by label propagation over a graph of similar documents.

1. Phrases (words and word pairs) that the seeds concentrate on one subject are a document's profile.
2. Documents that share a phrase are neighbours, all of them, and an edge weighs as much as the cosine of the two profiles.
3. Labels flow along the edges. A cosine is a sum over the shared phrases, so what all neighbours of a document vote is added up
   by phrase, exactly, and no pair is ever formed; the shares are then raised to a power. Seeds that their neighbours don't contradict are trusted and
   stay clamped; a document keeps every subject with a fair part of its neighbours' votes.
4. With what is then labelled the profiles are drawn up again, from all documents, and 2 and 3 repeated.
5. Of the subjects a document received, those remain that its own sentences bear out: at least a
   third of those that bear on any subject.

Weights are whole numbers (of 1,024ths), so that no sum depends on the order of its terms.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.leakage import spread
from chronoweave.session import materialize

WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_UNWRAP = re.compile(r"[ \t]*\n[ \t]*(?:[>#*|]+[ \t]*)?(?=[^\W\d_])(?![A-ZÀ-ÖØ-Þ])")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”»)\]]*\s+|\n+")
#: A phrase of one word must be purer than one of two, since words recur in other terms.
PURITY = {1: 0.85, 2: 0.6}
#: Weight of an even prior in a phrase's shares: without support no phrase counts as pure.
PRIOR_WEIGHT = 2.0
ONE = 1024
#: Bits of the maps that say which hashes may occur in a table; a map is a filter before a join, which decides.
MAP_BITS = 22
#: Up to so many phrases are looked up in a broadcast table.
TABLE_ROWS = 1_000_000
#: Where the graph is written out, a phrase's documents are divided into parts of about so many.
BLOCK_ROWS = 2_000
#: How many neighbours a document keeps in the graph written out (None: all), and from which cosine on; any shared phrase gives more than this.
KEPT, LEAST_COSINE = None, 1e-9
#: A subject stays with a document from this share of its neighbours' votes on.
RETAINED = 0.05
#: To which power the shares of votes are raised, so that a document's foremost subjects stand out.
INFLATION = 2
#: What share of its neighbours' votes a seed needs to be trusted.
TRUST = 0.2


def sentences(text: str) -> list[str]:
    """Sentences of a text; lines that were only wrapped are joined first."""
    return [s for s in _SENTENCE.split(_UNWRAP.sub(" ", text)) if s.strip()]


class _Hashes(dict):
    """Word -> 64-bit hash, whose lowest bit says whether the word has four letters or more."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = ((xxhash.xxh64_intdigest(word) & ~1) | (len(word) > 3)) - (1 << 63)
        return h


def _lists(values: array, ends: list[int], kind: str) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.array(ends, "int32")), pa.array(np.frombuffer(values, kind) if len(values) else np.zeros(0, kind)))


def _worded(documents: DataFrame) -> DataFrame:
    """(doc_id, words, sizes): hashes of the words of all sentences of two words at least, and the sentences' lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                batch = whole.slice(a, 1000)
                words, sizes, w_ends, s_ends = array("q"), array("i"), [0], [0]
                for text in batch.column("text"):
                    for s in sentences(text.as_py() or ""):
                        w = WORD.findall(s.lower())
                        if len(w) > 1:
                            words.extend(map(hashes.__getitem__, w))
                            sizes.append(len(w))
                    w_ends.append(len(words))
                    s_ends.append(len(sizes))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(words, w_ends, "int64"), _lists(sizes, s_ends, "int32")], names=["doc_id", "words", "sizes"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, words array<bigint>, sizes array<int>")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = a.view("uint64") * np.uint64(0x9E3779B97F4A7C15) + b.view("uint64")
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view("int64")


class _Batch:
    """The sentences of a batch of worded documents, as flat arrays; those in ``aside`` are left out."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        column = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
        length = lambda c: batch.column(c).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.ids = column("doc_id")
        words, sizes, n = flat("words"), flat("sizes"), length("sizes")
        self.doc = np.repeat(np.arange(len(n)), n)  # of each sentence
        starts = np.cumsum(n) - n
        self.no = np.arange(len(sizes)) - np.repeat(starts, n)
        self.of = np.repeat(np.arange(len(sizes)), sizes)  # the sentence of each word
        if "aside" in batch.schema.names:
            out = np.zeros(len(sizes), bool)
            out[np.repeat(starts, length("aside")) + flat("aside")] = True
            keep = ~out[self.of]
            words, self.of = words[keep], self.of[keep]
        self.words = words

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, sentence): words of four letters or more (lowest bit 0) and word pairs (lowest bit 1)."""
        w, of = self.words, self.of
        long = (w & 1) == 1
        near = of[1:] == of[:-1]
        pairs = _mix(w[:-1][near], w[1:][near]) | 1
        return np.concatenate([w[long] & ~1, pairs]), np.concatenate([of[long], of[1:][near]])

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        w, of = self.words, self.of
        near = of[2:] == of[:-2]
        return _mix(_mix(w[:-2][near], w[1:-1][near]), w[2:][near]), of[2:][near]


def _map_of(hashes: DataFrame, column: str) -> np.ndarray:
    """Which upper bits the hashes have: 2^MAP_BITS flags, however many the hashes are."""
    seen = hashes.select(F.shiftrightunsigned(F.col(column), 64 - MAP_BITS).cast("int").alias("b")).distinct().toArrow().column("b").to_numpy()
    known = np.zeros(1 << MAP_BITS, bool)
    known[seen] = True
    return np.packbits(known)


def _may_be(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes.view("uint64") >> np.uint64(64 - MAP_BITS)).astype("int64")
    return (known[at >> 3] >> (7 - (at & 7)).astype("uint8")) & 1 == 1


def _passages(worded: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, aside): the sentences of which half the word triples occur in an item, by their numbers."""

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for text in batch.column("text"):
                w = np.fromiter(map(hashes.__getitem__, WORD.findall((text.as_py() or "").lower())), "int64")
                if len(w) > 2:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(_mix(_mix(w[:-2], w[1:-1]), w[2:])))], names=["triple"])

    known = materialize(items.where("length(text) > 0").select("text").mapInArrow(of_items, "triple bigint").distinct(), "triples")
    handle = worded.sparkSession.sparkContext.broadcast(_map_of(known, "triple"))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b = _Batch(batch)
            triple, of = b.triples()
            hit = _may_be(handle.value, triple)
            n, hits = np.bincount(of, minlength=len(b.doc)), np.bincount(of[hit], minlength=len(b.doc))
            hit &= (2 * hits >= n)[of]
            of = of[hit]
            yield pa.RecordBatch.from_arrays([pa.array(b.ids[b.doc[of]]), pa.array(b.no[of].astype("int32")), pa.array(n[of].astype("int32")), pa.array(triple[hit])], names=["doc_id", "no", "n", "triple"])

    likely = worded.mapInArrow(run, "doc_id bigint, no int, n int, triple bigint")
    sure = likely.join(known, "triple").groupBy("doc_id", "no", "n").agg(F.count("*").alias("hits")).where("2 * hits >= n")
    return sure.groupBy("doc_id").agg(F.collect_list("no").alias("aside"))


def _pure(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(phrase, subject, purity) of the phrases concentrated on a subject, from weights(doc_id, subject, w)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            b = _Batch(batch)
            phrase, of = b.phrases()
            doc = b.doc[of]
            order = np.lexsort((doc, phrase))
            phrase, doc = phrase[order], doc[order]
            new = np.append(True, (phrase[1:] != phrase[:-1]) | (doc[1:] != doc[:-1]))[: len(phrase)]
            phrase, doc = phrase[new], doc[new]
            lists = batch.column("ws")
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            pairs = lists.flatten()
            subject, w = (pairs.field(c).to_numpy(zero_copy_only=False) for c in ("subject", "w"))
            k = n[doc]
            at = np.repeat((np.cumsum(n) - n)[doc], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            phrase, subject, w = np.repeat(phrase, k), subject[at], w[at]
            if not len(phrase):
                continue
            order = np.lexsort((subject, phrase))
            phrase, subject, w = phrase[order], subject[order], w[order]
            first = np.flatnonzero(np.append(True, (phrase[1:] != phrase[:-1]) | (subject[1:] != subject[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(phrase[first]), pa.array(subject[first]), pa.array(np.add.reduceat(w.astype("int64"), first))], names=["phrase", "subject", "n"])

    own = docs.join(weights.groupBy("doc_id").agg(F.collect_list(F.struct("subject", "w")).alias("ws")), "doc_id")
    per = own.mapInArrow(run, "phrase bigint, subject int, n bigint").groupBy("phrase", "subject").agg(F.sum("n").alias("n"))
    # Subjects with many seeds must not outweigh those with few: each counts as much as the mean.
    one = Window.partitionBy(F.lit(0))  # over a row a subject
    sizes = weights.groupBy("subject").agg(F.sum("w").alias("size")).select("subject", (F.avg("size").over(one) / F.col("size")).alias("scale"), F.count("*").over(one).alias("k"))
    scaled = per.join(F.broadcast(sizes), "subject").withColumn("m", F.col("n") * F.col("scale") / ONE)
    best = scaled.groupBy("phrase").agg(F.sum("n").alias("raw"), F.sum("m").alias("total"), F.max(F.struct("m", "subject", "k")).alias("b"))
    least = F.when(F.col("phrase").bitwiseAND(F.lit(1)) == 1, PURITY[2]).otherwise(PURITY[1])
    purity = F.round((F.col("b.m") + PRIOR_WEIGHT / F.col("b.k")) / (F.col("total") + PRIOR_WEIGHT), 9)
    return best.where(F.col("raw") > ONE).select("phrase", F.col("b.subject").alias("subject"), purity.alias("purity")).where(F.col("purity") >= least)


PROFILES = "doc_id bigint, profile array<int>, subjects array<int>, sentences array<int>"


def _profile(ids: np.ndarray, doc: np.ndarray, of: np.ndarray, phrase: np.ndarray, subject: np.ndarray, purity: np.ndarray) -> pa.RecordBatch:
    """PROFILES of hits sorted by (sentence, phrase), each once; sentences are numbered by document.

    profile has the phrases (32 bits of their hashes), subjects and sentences say in how many sentences each subject comes first.
    """
    order = np.lexsort((phrase, subject, of))
    o, s, d = of[order], subject[order], doc[order]
    first = np.flatnonzero(np.append(True, (o[1:] != o[:-1]) | (s[1:] != s[:-1])))
    score = np.round(np.add.reduceat(purity[order], first), 9)
    o, s, d = o[first], s[first], d[first]
    order = np.lexsort((s, -score, o))
    o, s, d = o[order], s[order], d[order]
    won = np.append(True, o[1:] != o[:-1])
    kinds = int(subject.max()) + 1
    counted, n = np.unique(d[won] * kinds + s[won], return_counts=True)
    order = np.lexsort((phrase >> 32, doc))
    d, p = doc[order], (phrase[order] >> 32).astype("int32")
    new = np.append(True, (d[1:] != d[:-1]) | (p[1:] != p[:-1]))
    d, p = d[new], p[new]
    there = np.unique(doc)
    lists = lambda owner, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(owner, minlength=len(ids))[there])).astype("int32")), pa.array(values.astype("int32")))
    return pa.RecordBatch.from_arrays([pa.array(ids[there]), lists(d, p), lists(counted // kinds, counted % kinds), lists(counted // kinds, n)], names=[c.split()[0] for c in PROFILES.split(", ")])


def _standing(b: _Batch, hit) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, sentence) of those phrases of a batch for which hit holds, once a sentence, in order."""
    phrase, of = b.phrases()
    keep = hit(phrase)
    phrase, of = phrase[keep], of[keep]
    order = np.lexsort((phrase, of))
    phrase, of = phrase[order], of[order]
    new = np.append(True, (phrase[1:] != phrase[:-1]) | (of[1:] != of[:-1]))[: len(phrase)]
    return phrase[new], of[new]


def _profiles(docs: DataFrame, pure: DataFrame) -> DataFrame:
    """PROFILES of the documents in which pure phrases stand. Up to TABLE_ROWS phrases are looked up in a broadcast table, more by a join; the result is the same."""
    spark = docs.sparkSession
    if pure.limit(TABLE_ROWS + 1).count() <= TABLE_ROWS:
        table = pure.orderBy("phrase").toArrow()  # its size was checked
        handle = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("phrase", "subject", "purity")))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, subject, purity = handle.value
            for batch in batches:
                if not batch.num_rows or not len(key):
                    continue
                b = _Batch(batch)
                phrase, of = _standing(b, lambda p: key[np.minimum(np.searchsorted(key, p), len(key) - 1)] == p)
                if len(phrase):
                    at = np.searchsorted(key, phrase)
                    yield _profile(b.ids, b.doc[of], of, phrase, subject[at], purity[at])

        return docs.mapInArrow(look_up, PROFILES)
    known = spark.sparkContext.broadcast(_map_of(pure, "phrase"))  # of fixed size

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b = _Batch(batch)
                phrase, of = _standing(b, lambda p: _may_be(known.value, p))
                yield pa.RecordBatch.from_arrays([pa.array(b.ids[b.doc[of]]), pa.array(b.no[of].astype("int32")), pa.array(phrase)], names=["doc_id", "no", "phrase"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def run(t: pa.Table) -> pa.RecordBatch:
            get = lambda c: t.column(c).to_numpy()
            ids, doc = np.unique(get("doc_id"), return_inverse=True)
            return _profile(ids, doc, doc * (int(get("no").max()) + 1) + get("no"), get("phrase"), get("subject"), get("purity"))

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([kept, t]) if kept is not None else t
            d = t.column("doc_id").to_numpy()
            cut = int(np.searchsorted(d, d[-1]))
            if cut:
                yield run(t.slice(0, cut))
            kept = t.slice(cut)
        if kept is not None and kept.num_rows:
            yield run(kept)

    hits = docs.mapInArrow(likely, "doc_id bigint, no int, phrase bigint").join(pure, "phrase").select("doc_id", "no", "phrase", "subject", "purity")
    return hits.repartition("doc_id").sortWithinPartitions("doc_id", "no", "phrase").mapInArrow(gather, PROFILES)


def similar_documents(profiles: DataFrame) -> DataFrame:
    """(doc_id, other, weight): the graph written out, in both directions: all pairs of documents that share a phrase, by the cosine of their profiles in 64ths.

    profiles: (doc_id, profile). As many rows as there are pairs, so for small tables; phrase_votes gives the votes over the same graph
    without its pairs. Each of a phrase's documents meets all of them, a part at a time, so that no task has to hold a long list.
    """
    rows = profiles.select("doc_id", F.size("profile").alias("size"), F.explode("profile").alias("phrase"))
    parts = rows.groupBy("phrase").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("parts"))
    rows = rows.join(parts, "phrase")
    one = rows.select("phrase", F.pmod(F.xxhash64("doc_id"), "parts").cast("int").alias("part"), "doc_id", "size")
    two = rows.select("phrase", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("doc_id").alias("other"), F.col("size").alias("others"))
    shared = one.join(two, ["phrase", "part"]).where("doc_id <> other").groupBy("doc_id", "other").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("others").alias("others"))
    cosine = shared.select("doc_id", "other", (F.col("n") / F.sqrt(F.col("size").cast("double") * F.col("others"))).alias("cosine")).where(F.col("cosine") >= LEAST_COSINE)
    if KEPT is not None:
        best = Window.partitionBy("doc_id").orderBy(F.desc("cosine"), "other")
        cosine = cosine.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= KEPT)
    return cosine.select("doc_id", "other", F.round(F.col("cosine") * 64).cast("int").alias("weight"))


def _shares(flow: DataFrame) -> DataFrame:
    """(doc_id, subject, w) of flow(doc_id, subject, v): what is voted, in shares of the document's votes."""
    share = F.col("v") / F.sum("v").over(Window.partitionBy("doc_id"))
    return flow.select("doc_id", "subject", F.round(share * ONE).cast("int").alias("w"))


def _sharpened(votes: DataFrame) -> DataFrame:
    """Votes by the INFLATION-th power of their shares: a document's neighbours are all that share a phrase, also those of its other subjects."""
    share = F.pow(F.col("w") / ONE, F.lit(INFLATION))
    power = votes.select("doc_id", "subject", F.round(share * ONE * ONE).cast("bigint").alias("v"))
    return _shares(power)


def _votes(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, w): the neighbours' labels by the edges' weights, in shares."""
    lists = labels.groupBy(F.col("doc_id").alias("other")).agg(F.collect_list(F.struct("subject", "w")).alias("own"))
    return _shares(edges.join(lists, "other").select("doc_id", "weight", F.explode("own").alias("x")).groupBy("doc_id", "x.subject").agg(F.sum(F.col("weight") * F.col("x.w")).alias("v")))


def phrase_votes(profiles: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, subject, w): the labels of all documents that share a phrase, by the cosines of the profiles, in shares.

    The sum of cosine x label over all neighbours is, up to a factor of the document that falls out of the shares, the sum over its phrases of what
    all documents with the phrase have of the subject, each divided by the root of its profile's size, less its own part.
    Up to TABLE_ROWS sums are looked up in a broadcast table, more by a join; the result is the same.
    """
    part = F.round(F.col("w") * ONE / F.sqrt(F.size("profile"))).cast("bigint")
    held = labels.join(profiles.select("doc_id", "profile"), "doc_id").select("doc_id", "subject", "profile", part.alias("part"))
    sums = materialize(held.select(F.explode("profile").alias("phrase"), "subject", "part").groupBy("phrase", "subject").agg(F.sum("part").alias("v")), "sums")
    own = held.select("doc_id", "subject", (-F.size("profile") * F.col("part")).alias("v"))
    if sums.limit(TABLE_ROWS + 1).count() <= TABLE_ROWS:
        table = sums.orderBy("phrase", "subject").toArrow()  # its size was checked
        handle = profiles.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("phrase", "subject", "v")))

        def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, subject, v = handle.value
            kinds = int(subject.max(initial=0)) + 1
            for batch in batches:
                lists = batch.column("profile")
                phrase = lists.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                low = np.searchsorted(key, phrase)
                n = np.searchsorted(key, phrase, "right") - low
                at = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                if not len(at):
                    continue
                to = np.repeat(doc, n) * kinds + subject[at]
                order = np.argsort(to, kind="stable")
                to = to[order]
                first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
                there = to[first]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(there // kinds)), pa.array((there % kinds).astype("int32")), pa.array(np.add.reduceat(v[at][order], first))], names=["doc_id", "subject", "v"])

        heard = profiles.select("doc_id", "profile").mapInArrow(look_up, "doc_id bigint, subject int, v bigint")
    else:
        lists = sums.groupBy("phrase").agg(F.collect_list(F.struct("subject", "v")).alias("xs"))  # a subject each
        heard = profiles.select("doc_id", F.explode("profile").alias("phrase")).join(lists, "phrase").select("doc_id", F.explode("xs").alias("x")).select("doc_id", "x.subject", "x.v")
    return _shares(heard.unionByName(own).repartition("doc_id").groupBy("doc_id", "subject").agg(F.sum("v").alias("v")).where(F.col("v") > 0))


def propagate(edges: DataFrame | Callable[[DataFrame], DataFrame], seeds: DataFrame, labels: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(labels, votes), each (doc_id, subject, w), after some rounds; votes are the last round's, however small.

    edges: (doc_id, other, weight), or what gives the votes over a graph that isn't written out.
    A seed is trusted, and clamped to half of its document's weight at least, unless its neighbours vote, and less than TRUST for it.
    """
    vote = edges if callable(edges) else partial(_votes, edges)
    trusted = votes = None
    for i in range(rounds):
        votes = materialize(vote(labels), f"votes{i}")
        heard = votes.where(F.col("w") >= int(RETAINED * ONE))
        if trusted is None:
            borne = seeds.join(votes.where(F.col("w") >= int(TRUST * ONE)).select("doc_id", "subject"), ["doc_id", "subject"], "left_semi")
            unheard = seeds.join(votes.select("doc_id").distinct(), "doc_id", "left_anti")
            kept = borne.unionByName(unheard)
            trusted = materialize(kept.withColumn("w", F.round(F.lit(ONE) / F.count("*").over(Window.partitionBy("doc_id"))).cast("int")), "trusted")
        # Half of a trusted document's weight is its seed's; the other half is open to further subjects.
        halves = heard.join(trusted.select("doc_id").distinct().withColumn("half", F.lit(True)), "doc_id", "left").select("doc_id", "subject", F.when(F.col("half"), F.col("w") / 2).otherwise(F.col("w")).alias("w"))
        both = trusted.select("doc_id", "subject", (F.col("w") / 2).alias("w")).unionByName(halves)
        labels = materialize(both.groupBy("doc_id", "subject").agg(F.sum("w").cast("int").alias("w")).where(F.col("w") > 0), f"labels{i}")
    return labels, votes


def subjects_of(documents: DataFrame, labels: DataFrame, items: DataFrame | None = None, share: float = 1 / 3, rounds: int = 2) -> DataFrame:
    """(doc_id, subject, sentences, share): every subject with at least ``share`` of the sentences that bear on any subject.

    labels(doc_id, subject) are the seeds: repeated ones count once, a document may have
    several, those without document or subject are ignored. Passages of items(item_id,
    text) are left aside. Documents without text, and such that bear on no subject, have no row, labelled or not; a repeated doc_id
    counts once (the greatest by its words' hashes). Without usable labels the result is empty.
    The names of the subjects, a taxonomy, are held on the driver.
    """
    spark = documents.sparkSession
    docs = documents.where("doc_id IS NOT NULL AND length(text) > 0").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    worded = materialize(_worded(spread(docs)), "worded")
    if worded.groupBy("doc_id").count().where("count > 1").limit(1).count():
        worded = materialize(worded.groupBy("doc_id").agg(F.max(F.struct("words", "sizes")).alias("x")).select("doc_id", "x.*"), "worded")
    if items is not None:
        worded = worded.join(materialize(_passages(worded, items), "aside"), "doc_id", "left")
    given = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("subject").cast("string").alias("subject")).distinct()
    names = sorted(r["subject"] for r in given.select("subject").distinct().collect())
    taxonomy = spark.createDataFrame(list(enumerate(names)), "no int, name string")
    numbered = given.join(F.broadcast(taxonomy), F.col("subject") == F.col("name")).select("doc_id", F.col("no").alias("subject"))
    seeds = materialize(numbered.withColumn("w", F.round(F.lit(ONE) / F.count("*").over(Window.partitionBy("doc_id"))).cast("int")), "seeds")
    state = seeds
    for i in range(rounds):
        pure = materialize(_pure(worded, state), f"pure{i}")
        profiles = materialize(_profiles(worded, pure), f"profiles{i}")
        state, votes = propagate(lambda own, profiles=profiles: _sharpened(phrase_votes(profiles, own)), seeds, state, 2 if i == 0 else 1)
    whole = F.aggregate("sentences", F.lit(0), lambda a, x: a + x)
    counted = profiles.select("doc_id", whole.alias("all"), F.explode(F.arrays_zip("subjects", "sentences")).alias("x"))
    shares = counted.select("doc_id", F.col("x.subjects").alias("subject"), F.col("x.sentences").cast("bigint").alias("sentences"), (F.col("x.sentences") / F.col("all")).alias("share")).where(F.col("share") >= share - 1e-9)
    received = state.select("doc_id", "subject").unionByName(votes.select("doc_id", "subject"))
    borne_out = shares.join(received, ["doc_id", "subject"], "left_semi")
    rows = borne_out.select("doc_id", "subject", "sentences", "share")
    return rows.join(F.broadcast(taxonomy), F.col("subject") == F.col("no")).select("doc_id", F.col("name").alias("subject"), "sentences", "share")
