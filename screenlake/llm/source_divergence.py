"""How the sources of a language differ in their words, with terms found by iceberg prefix refinement.

1. *Prefixes.*  A task counts for each language the documents that hold a term with a given prefix
   of ``length`` bytes; a document is whole in one task, so counts add up.  Prefixes in fewer than
   ``least`` documents drop out, and the next level extends the others to four times their length,
   until no prefix is left that is not a whole term.  Survivors reach the tasks as bits of a bitmap of
   fixed size; a wrong bit only lets a row through, which its own count then drops.
2. *Counts.*  The occurrences of the kept terms by language and source.
3. *Divergence.*  Shares are smoothed and scaled to 10^9; f is the triangular discrimination of two
   shares.  ``term`` rows rank the terms that a source has more often than its language; ``pair``
   rows rank the other sources by f summed over all kept terms, also those that neither source has.
   Pairs are summed tile by tile: blocks of sources against each other, for parts of the terms.

A term is a run of ASCII letters and characters above U+007F, with A-Z lower-cased.  Defined cases:
null language, source and text are empty strings; a source without a term has count 0 for every kept
term; a language without kept terms gives pairs of value 0 and no terms; repeated rows and rows that
share an id are documents of their own; texts of any length are read in segments; ties go to the item
first in byte order; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenlake.llm import bitmap
from screenlake.llm.arrow import parts
from screenlake.session import cut_lineage

#: Bytes of the first prefixes, and how much longer those of the next level are.
FIRST, LONGER = 8, 4
#: Bytes read at once; distinct terms of documents aggregated at once.
SEGMENT, PAIRS = 4 << 20, 1 << 21
#: Sources of a block, and terms of a tile.
SOURCES, TERMS = 256, 4096
SCALE = 10**9

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _pieces(data: bytes, limit: int) -> Iterator[bytes]:
    """Parts of ``data`` that no term crosses."""
    at = 0
    while at < len(data):
        end = min(at + limit, len(data))
        while end < len(data) and _LETTER[data[end]]:
            end += 1
        yield data[at:end]
        at = end


def _terms(found: list[tuple[int, bytes]], above: int) -> tuple[np.ndarray, pa.DictionaryArray, np.ndarray]:
    """(document, term, occurrences) of terms of more than ``above`` bytes, each term of a document once."""
    codes = np.frombuffer(b" ".join(d for _, d in found), np.uint8)
    edge = np.diff(np.concatenate([[False], _LETTER[codes], [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letters = codes[_LETTER[codes]]
    if above:
        sizes = ends - starts
        letters, starts, ends = letters[np.repeat(sizes > above, sizes)], starts[sizes > above], ends[sizes > above]
    doc = np.array([d for d, _ in found], np.int64)[np.searchsorted(np.cumsum([len(d) + 1 for _, d in found]), starts, side="right")]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.tobytes())]).dictionary_encode()
    size = max(1, len(terms.dictionary))
    key, counts = np.unique(doc * size + np.asarray(terms.indices), return_counts=True)
    return key // size, pa.DictionaryArray.from_arrays(pa.array((key % size).astype(np.int32)), terms.dictionary), counts


class _Documents:
    """The distinct terms of some whole documents: document, term number and count of each."""

    def __init__(self, groups: list[tuple[str, str]], parts: list[tuple[np.ndarray, pa.DictionaryArray, np.ndarray]]):
        self.groups = groups
        terms = pa.chunked_array([t for _, t, _ in parts]).unify_dictionaries()
        self.terms = terms.chunk(0).dictionary
        size = max(1, len(self.terms))
        doc, term, count = np.concatenate([d for d, _, _ in parts]), np.concatenate([np.asarray(c.indices) for c in terms.chunks]), np.concatenate([n for _, _, n in parts])
        # a document of several segments has terms in more than one
        key, of = np.unique(doc * size + term, return_inverse=True)
        self.doc, self.term, self.count = key // size, key % size, np.bincount(of, count, len(key)).astype(np.int64)
        self.langs = sorted({g[0] for g in groups})
        self.lang = np.array([self.langs.index(g[0]) for g in groups], np.int64)[self.doc]

    def known(self, known: np.ndarray, length: int | None) -> np.ndarray:
        """Whether the first ``length`` bytes of each term are marked for its language."""
        import xxhash

        cut = self.terms if length is None else pc.binary_slice(self.terms, 0, length)
        cut = cut.dictionary_encode()
        names, at = cut.dictionary.to_pylist(), np.asarray(cut.indices).astype(np.int64)[self.term] * len(self.langs) + self.lang
        pairs, of = np.unique(at, return_inverse=True)
        # as Spark's xxhash64(lang, term)
        seeds = [xxhash.xxh64_intdigest(k.encode(), 42) for k in self.langs]
        fps = [xxhash.xxh64_intdigest(names[p // len(seeds)], seeds[p % len(seeds)]) for p in pairs.tolist()]
        return bitmap.marked(known, np.array(fps, np.uint64))[of]


def _each(work: Callable[[_Documents], pa.RecordBatch], above: int = 0) -> Callable:
    """Runs ``work`` over whole documents in parts of bounded size, from (lang, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, done, waiting, size, pairs = [], [], [], 0, 0
        for batch in parts(batches):
            for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if pairs >= PAIRS:
                    yield work(_Documents(groups, done))
                    groups, done, pairs = [], [], 0
                # a document's number is its place in ``groups``
                groups.append((lang, source))
                for piece in _pieces(text.encode().lower(), SEGMENT):
                    waiting.append((len(groups) - 1, piece))
                    size += len(piece)
                    if size >= SEGMENT:
                        done.append(_terms(waiting, above))
                        pairs += len(done[-1][0])
                        waiting, size = [], 0
                # a document belongs to one part
                if waiting and pairs >= PAIRS:
                    done.append(_terms(waiting, above))
                    waiting, size = [], 0
        if waiting:
            done.append(_terms(waiting, above))
        if done:
            yield work(_Documents(groups, done))

    return run


def _prefixes(before: int, length: int, survivors) -> Callable:
    """(lang, term, whole, docs): documents with each term longer than ``before`` bytes, cut to ``length``."""

    def work(d: _Documents) -> pa.RecordBatch:
        sizes = np.asarray(pc.binary_length(d.terms)).astype(np.int64)[d.term] if len(d.doc) else np.empty(0, np.int64)
        ok = np.ones(len(d.doc), bool) if survivors is None else d.known(np.frombuffer(survivors.value, np.uint8), before)
        cut = pc.binary_slice(d.terms, 0, length).dictionary_encode()
        kinds = len(d.langs)
        key = (np.asarray(cut.indices)[d.term[ok]].astype(np.int64) * 2 + (sizes[ok] <= length)) * kinds + d.lang[ok]
        width = max(1, 2 * len(cut.dictionary) * kinds)
        key, docs = np.unique(np.unique(d.doc[ok] * width + key) % width, return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(d.langs, pa.string()).take(pa.array(key % kinds)), cut.dictionary.take(pa.array(key // kinds // 2)), pa.array(key // kinds % 2 == 1), pa.array(docs)], names=["lang", "term", "whole", "docs"]
        )

    return _each(work, before)


def _occurrences(kept) -> Callable:
    """(lang, term, in) of terms that may be kept; ``in`` holds the occurrences by source."""

    def work(d: _Documents) -> pa.RecordBatch:
        ok = d.known(np.frombuffer(kept.value, np.uint8), None)
        groups = sorted(set(d.groups))
        number = {g: i for i, g in enumerate(groups)}
        group = np.array([number[g] for g in d.groups], np.int64)[d.doc[ok]]
        key, of = np.unique(d.term[ok] * len(groups) + group, return_inverse=True)
        n = np.bincount(of, d.count[ok], len(key)).astype(np.int64)
        # the groups of a language stand together, so a term's sources of one language do too
        lang = np.array([d.langs.index(g[0]) for g in groups], np.int64)[key % len(groups)]
        term = key // len(groups)
        first = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])])) if len(key) else np.empty(0, np.int64)
        entries = pa.StructArray.from_arrays([pa.array([g[1] for g in groups], pa.string()).take(pa.array(key % len(groups))), pa.array(n)], names=["source", "n"])
        found = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), entries)
        return pa.RecordBatch.from_arrays([pa.array(d.langs, pa.string()).take(pa.array(lang[first])), d.terms.take(pa.array(term[first])), found], names=["lang", "term", "in"])

    return _each(work)


def kept_terms(docs: DataFrame, least: int = 10) -> DataFrame:
    """(lang, term) of the terms in at least ``least`` documents of a language, from (lang, source, text)."""
    spark, found, survivors, before, length = docs.sparkSession, None, None, 0, FIRST
    while True:
        rows = docs.mapInArrow(_prefixes(before, length, survivors), "lang string, term binary, whole boolean, docs long")
        level = cut_lineage(rows.groupBy("lang", "term", "whole").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least))
        whole = level.where("whole").select("lang", "term")
        found = whole if found is None else found.unionByName(whole)
        longer = level.where("NOT whole")
        if longer.isEmpty():
            return found
        survivors = spark.sparkContext.broadcast(bitmap.build(longer.select(F.xxhash64("lang", "term").alias("fp"))))
        before, length = length, LONGER * length


def term_counts(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n), n > 0, of the kept terms, and the kept terms."""
    kept = cut_lineage(kept_terms(docs, least))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap.build(kept.select(F.xxhash64("lang", "term").alias("fp"))))
    rows = docs.mapInArrow(_occurrences(bits), "lang string, term binary, in array<struct<source: string, n: bigint>>")
    # dealt by term before the sources become rows; the sums need no exchange of their own
    rows = rows.repartition("lang", "term").select("lang", "term", F.inline("in"))
    counted = rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")).join(kept, ["lang", "term"], "left_semi")
    return cut_lineage(counted), kept


def _share(n: str, total: str, v: str) -> F.Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)), exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10,0)) * (cast({n} as decimal(19,0)) + 2)) div (cast({total} as decimal(19,0)) + 2 * {v})")


def _tile(key: tuple, terms: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Sums of f over the terms of one tile, for its sources of the first block against the second."""
    lang, a, b, _ = key
    names = sources["source"].to_numpy()
    order = np.argsort(names)
    names, absent = names[order], sources["absent"].to_numpy()[order]
    row, of = np.unique(terms["term"].to_numpy(), return_inverse=True)
    first, second = np.flatnonzero(names // SOURCES == a), np.flatnonzero(names // SOURCES == b)
    out = np.zeros((len(first), len(second)), np.int64)
    for at in range(0, len(row), 512):
        some = (of >= at) & (of < at + 512)
        p = np.tile(absent, (min(512, len(row) - at), 1))
        p[of[some] - at, np.searchsorted(names, terms["number"].to_numpy()[some])] = terms["p"].to_numpy()[some]
        for i, g in enumerate(first):
            own, other = p[:, g, None], p[:, second]
            out[i] += ((own - other) ** 2 // (own + other)).sum(0)
    i, j = np.nonzero(names[first][:, None] < names[second])
    return pd.DataFrame({"lang": lang, "g": names[first][i], "h": names[second][j], "value": out[i, j]})


def _pairs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, g, h, value), g < h by number: f summed over the kept terms."""
    tiles = F.expr(f"explode(transform(sequence(0, cast((sources - 1) div {SOURCES} as int)), b -> struct(least(b, number div {SOURCES}) as a, greatest(b, number div {SOURCES}) as b)))")
    n_parts = F.expr(f"cast((v + {TERMS} - 1) div {TERMS} as int)")
    blocks = groups.where("v > 0 AND sources > 1").select(F.col("lang").alias("lang"), F.col("number").alias("source"), F.col("absent").alias("absent"), n_parts.alias("parts"), tiles.alias("t"))
    sides = blocks.select("lang", "t.a", "t.b", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), "source", "absent")
    rows = counts.where("sources > 1").select("lang", F.pmod(F.xxhash64("term"), n_parts).cast("int").alias("part"), tiles.alias("t"), "number", "term", "p")
    rows = rows.select("lang", "t.a", "t.b", "part", "number", "term", "p")
    key = ["lang", "a", "b", "part"]
    summed = rows.groupBy(key).cogroup(sides.groupBy(key)).applyInPandas(_tile, "lang string, g long, h long, value long")
    return summed.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows with all other sources of the
    language, ``term`` rows with the ``top`` terms that a source has more often."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counts, kept = term_counts(docs, least)
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"))
    groups = groups.withColumn("number", F.expr("row_number() OVER (PARTITION BY lang ORDER BY source) - 1").cast("long")).withColumn("sources", F.expr("count(*) OVER (PARTITION BY lang)"))
    groups = cut_lineage(groups.withColumn("absent", F.when(F.col("v") > 0, _share("0", "total", "v"))))
    shares = counts.join(groups, ["lang", "source"]).withColumn("p", _share("n", "total", "v"))
    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    sums = whole.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"))
    f = F.expr("((p - q) * (p - q)) div (p + q)")
    terms = shares.join(whole, ["lang", "term"]).join(sums, "lang").withColumn("q", _share("lang_n", "lang_total", "v")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), f.alias("value"))
    order = F.expr("row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)")
    terms = terms.withColumn("rank", order).where(F.col("rank") <= top)
    # every pair of sources is a row of the result
    own, other = groups.select("lang", "source", F.col("number").alias("x")), groups.select("lang", F.col("source").alias("item"), F.col("number").alias("y"))
    met = own.join(other, "lang").where("x <> y").withColumns({"g": F.least("x", "y"), "h": F.greatest("x", "y")}).join(_pairs(shares, groups), ["lang", "g", "h"], "left")
    pairs = met.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")).withColumn("rank", order)
    return pairs.unionByName(terms)
