"""Frequent phrases whose words belong together, by Rabin-Karp fingerprints.

1. *Fingerprints.*  A task numbers the words of a chunk of texts, sums their names into a prefix
   polynomial and so has the 64-bit fingerprint of every n-gram by one subtraction.  n-grams of
   a chunk are told apart by their word numbers, not by fingerprints.
2. *Aggregation.*  One row per chunk and n-gram (fingerprint, count, and in one number a check of 31
   bits from a second polynomial and a pointer to a document) is dealt by fingerprint; what has less
   than ``least`` occurrences drops out.  An n-gram is only sent if both n-grams of one word less
   inside it may be frequent: their fingerprints are marked in a bitmap of fixed size.  A full
   bitmap sends more rows and changes no result.
3. *Verification.*  The least and the greatest pointer of each fingerprint left are followed into the
   texts, which must agree, or the job ends with an error; only here is a phrase made into a string.
   Two phrases are taken for one if they share 95 bits and lie outside both pointers.
4. *Scores.*  Counts of the parts of a phrase are counts of frequent phrases too; joins and decimals
   do the rest.

Pieces are what stands between ``.,;:!?`` and line ends; words are what stands between blanks and
tabs; A-Z is lower-cased.  Defined cases: a null text is empty, a null language is ``und``; a text
of any length is read in segments that share n - 1 words; ids are not used, so nulls and repeats
among them do nothing; a repeated row counts each time; the documents are read once for each length; ties of the score go to more occurrences,
then to the phrase first in byte order; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from screenlake.llm import bitmap
from screenlake.llm.arrow import parts
from screenlake.llm.repeats import BASE, _mixed, _power, _powers
from screenlake.session import cut_lineage

#: Bytes of text whose n-grams a task aggregates at once, and bytes of a long text read at once.
CHUNK, SEGMENT = 4 << 20, 1 << 20
#: Odd multipliers of the two polynomials.
BASES = (BASE, 0xC2B2AE3D27D4EB4F)
#: Rows of a language are ranked in so many parts before they are ranked together.
PARTS = 64

_SPLIT = np.zeros(256, bool)
_SPLIT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _SPLIT.copy()
_GAP[[0x20, 0x09]] = True


def _bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end."""
    edge = np.diff(np.concatenate([[True], _GAP[codes], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def segments(data: bytes, n: int, limit: int = SEGMENT) -> Iterator[bytes]:
    """Parts of ``data`` that together hold every run of ``n`` words once."""
    at, room = 0, limit
    while at + room < len(data):
        part = data[at : at + room]
        starts, ends = _bounds(np.frombuffer(part, np.uint8))
        whole = len(starts) - (len(ends) > 0 and ends[-1] == len(part))  # the last word may go on
        if whole < n:
            if not whole and not len(starts):
                at += room
                room = limit
            else:
                room *= 2
            continue
        yield part[: ends[whole - 1]]
        at, room = at + int(starts[whole - n + 1] if n > 1 else ends[whole - 1]), limit
    yield data[at:]


class _Chunk:
    """The words of many segments (row, text): numbers, names and pieces."""

    def __init__(self, segments: list[tuple[int, bytes]], langs: list[str]):
        import xxhash

        codes = np.frombuffer(b"\n".join(s for _, s in segments), np.uint8)
        starts, ends = _bounds(codes)
        self.piece = np.cumsum(_SPLIT[codes], dtype=np.int32)[starts]
        segment_ends = np.cumsum([len(s) + 1 for _, s in segments])
        segment = np.searchsorted(segment_ends, starts, side="right")
        self.row = np.array([r for r, _ in segments], np.int64)[segment]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
        letters = codes[~_GAP[codes]].tobytes()
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters)]).dictionary_encode()
        kinds = sorted(set(langs))
        lang = np.array([kinds.index(x) for x in langs], np.int64)[segment]
        self.kinds = len(words.dictionary) * len(kinds)
        self.ids = np.asarray(words.indices).astype(np.int64) * len(kinds) + lang
        self.sums, self.inverse = [], []
        # a second polynomial with names and a base of its own for the check
        for seed, base in enumerate(BASES):
            name = np.array([xxhash.xxh64_intdigest(w.as_py(), seed) for w in words.dictionary], np.uint64)
            of_lang = np.array([xxhash.xxh64_intdigest(k.encode(), seed) for k in kinds], np.uint64)
            terms = _mixed(name[np.asarray(words.indices)] + _mixed(of_lang)[lang]) * _powers(len(starts), base)
            self.sums.append(np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)]))
            self.inverse.append(_powers(len(starts), pow(base, -1, 1 << 64)))
        self.starts, self.ends, self.codes = starts, ends, codes

    def fingerprints(self, n: int, which: int = 0) -> np.ndarray:
        """Of the n words that start at each word; also where they are of several pieces."""
        sums, w = self.sums[which], max(0, len(self.ids) - n + 1)
        return _mixed((sums[n:] - sums[:w]) * self.inverse[which][:w] + _power(n))

    def checks(self, n: int) -> np.ndarray:
        return self.fingerprints(n, 1) >> np.uint64(33)

    def inside(self, n: int) -> np.ndarray:
        """Whether the n words that start at each word are of one piece."""
        w = max(0, len(self.ids) - n + 1)
        return self.piece[:w] == self.piece[len(self.piece) - w :]

    def text(self, at: int, n: int) -> str:
        return b" ".join(self.codes[a:b].tobytes() for a, b in zip(self.starts[at : at + n].tolist(), self.ends[at : at + n].tolist(), strict=True)).decode()

    def occurrences(self, n: int, known: np.ndarray | None) -> tuple[np.ndarray, ...]:
        """(fingerprint, check, count, row, first word) of each distinct n-gram."""
        w = len(self.ids) - n + 1
        if w <= 0:
            return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
        ok = self.inside(n)
        if known is not None:
            shorter = bitmap.marked(known, self.fingerprints(n - 1))
            ok &= shorter[:w] & shorter[1 : w + 1]
        at = np.flatnonzero(ok)
        key = self.ids[at]
        for k in range(1, n):
            if k > 1:
                key = np.unique(key, return_inverse=True)[1]
            key = key * self.kinds + self.ids[at + k]
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        at = at[first]
        return self.fingerprints(n)[at], self.checks(n)[at], counts, self.row[at], at


def _counted(n: int, frequent) -> Callable:
    """(fp, mark, count) per chunk from (lang, text, pointer); a mark is 31 bits of check and 32 of pointer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if frequent is None else np.frombuffer(frequent.value, np.uint8)
        waiting, langs, size = [], [], 0

        def send() -> pa.RecordBatch:
            fp, check, count, pointer, _ = _Chunk(waiting, langs).occurrences(n, known)
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(check.astype(np.int64) << 32 | pointer), pa.array(count)], names=["fp", "mark", "count"])

        for batch in parts(batches):
            for lang, text, pointer in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for part in segments(text.encode().lower(), n):
                    waiting.append((pointer, part))
                    langs.append(lang)
                    size += len(part)
                    if size >= CHUNK:
                        yield send()
                        waiting, langs, size = [], [], 0
        if waiting:
            yield send()

    return run


def _frequent(texts: DataFrame, longest: int, least: int) -> DataFrame:
    """(fp, check, n_words, f, first, last): fingerprints with ``least`` occurrences and two pointers."""
    spark, known, found = texts.sparkSession, None, None
    for n in range(1, longest + 1):
        rows = texts.mapInArrow(_counted(n, known), "fp long, mark long, count long").repartition("fp")
        counted = rows.groupBy("fp", F.shiftright("mark", 32).alias("check")).agg(F.sum("count").alias("f"), F.min("mark").alias("first"), F.max("mark").alias("last"))
        kept = cut_lineage(counted.where(F.col("f") >= least).withColumn("n_words", F.lit(n).cast("long")))
        found = kept if found is None else found.unionByName(kept)
        if n < longest:
            known = spark.sparkContext.broadcast(bitmap.build(kept))
    return found


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, check, lang, phrase) of the asked fingerprints, from (lang, text, asked).

    Texts are looked through together: what one of them is asked for may be found in another."""
    texts: list[tuple[int, bytes]] = []
    langs: list[str] = []
    wanted: dict[int, set[tuple[int, int]]] = {}

    def found() -> pa.RecordBatch:
        out = []
        keys = {n: np.unique(np.array([fp for fp, _ in names], np.int64)) for n, names in wanted.items()}
        # parts that share the words of the longest n-gram hold the shorter ones too
        cut = [(k, part) for k, text in texts for part in segments(text, max(keys, default=1))]
        for some, kinds in _chunks(cut, langs):
            chunk = _Chunk(some, kinds)
            for n, mine in keys.items():
                fps = chunk.fingerprints(n).view(np.int64)
                at = np.minimum(np.searchsorted(mine, fps), len(mine) - 1)
                at = np.flatnonzero((mine[at] == fps) & chunk.inside(n))
                checks = chunk.checks(n)[at].astype(np.int64)
                order = np.lexsort((checks, fps[at]))
                at, checks = at[order], checks[order]
                # one place for each name
                new = np.flatnonzero(np.concatenate([[True], (np.diff(fps[at]) != 0) | (np.diff(checks) != 0)])) if len(at) else at
                at, checks = at[new], checks[new]
                rows = zip(at.tolist(), fps[at].tolist(), checks.tolist(), chunk.row[at].tolist(), strict=True)
                out += [(fp, check, langs[row], chunk.text(i, n)) for i, fp, check, row in rows if (fp, check) in wanted[n]]
        columns = zip(*out, strict=True) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["fp", "check", "lang", "phrase"])

    size = 0
    for batch in parts(batches):
        for lang, text, names in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            texts.append((len(langs), text.encode().lower()))
            langs.append(lang)
            for a in names:
                wanted.setdefault(a["n_words"], set()).add((a["fp"], a["check"]))
            size += len(text) + 16 * len(names)
            if size >= CHUNK:
                yield found()
                texts.clear(), langs.clear(), wanted.clear()
                size = 0
    yield found()


def _chunks(cut: list[tuple[int, bytes]], langs: list[str]) -> Iterator[tuple[list[tuple[int, bytes]], list[str]]]:
    """Segments in runs of about ``CHUNK`` bytes, with their languages."""
    some: list[tuple[int, bytes]] = []
    size = 0
    for row, part in cut:
        some.append((row, part))
        size += len(part)
        if size >= CHUNK:
            yield some, [langs[r] for r, _ in some]
            some, size = [], 0
    if some:
        yield some, [langs[r] for r, _ in some]


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, lang: str = "lang", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n_words, f) of all phrases of up to ``longest`` words with ``least``
    occurrences, and (lang, n), the number of words of each language."""
    pointer = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("pointer")
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"), pointer)
    totals = texts.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(r"[^ \t.,;:!?\n-\r]+"))).cast("long").alias("n"))
    found = _frequent(texts, longest, least)
    ends = F.explode(F.array_distinct(F.transform(F.array("first", "last"), lambda m: m.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))))
    # no more names for a pointer than its texts have n-grams
    asked = found.select(ends.alias("pointer"), F.struct("fp", "check", "n_words").alias("name")).groupBy("pointer").agg(F.collect_list("name").alias("asked"))
    read = texts.join(asked, "pointer").select("lang", "text", "asked").mapInArrow(_resolved, "fp long, check long, lang string, phrase string")
    read = read.groupBy("fp", "check").agg(F.min(F.struct("lang", "phrase")).alias("one"), F.max(F.struct("lang", "phrase")).alias("other"))
    counted = found.join(read, ["fp", "check"], "left")
    one = (
        F.when(F.col("one") == F.col("other"), F.col("one")).when(F.col("one").isNull(), F.raise_error(F.lit("the documents changed between two readings")))
        .otherwise(F.raise_error(F.lit("two phrases share 95 bits of fingerprint")))
    )
    return cut_lineage(counted.withColumn("one", one).select("one.lang", "one.phrase", "n_words", "f")), totals


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    A phrase inside a longer one that has ``inside`` per cent of its occurrences is left out.
    Products are decimals of 38 digits, exact while occurrences stay below 10^16."""
    if not 2 <= longest <= 8 or least < 1:
        raise ValueError("phrases have 2 to 8 words and occur at least once")
    counts, totals = phrase_counts(docs, longest, least, lang, text)
    candidates = counts.where("n_words > 1").withColumnRenamed("f", "a")
    words = F.split("phrase", " ")
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = candidates.withColumn("words", words).withColumn("k", F.explode(F.sequence(F.lit(1), (F.col("n_words") - 1).cast("int"))))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("n_words").cast("int")).alias("rest"))
    left = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    wide = lambda c: f"cast({c} as decimal(19,0))"
    scored = scored.withColumn("score", F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the most frequent longer candidate around each phrase
    spans = F.expr("flatten(transform(sequence(2, cast(n_words as int) - 1), m -> transform(sequence(1, cast(n_words as int) - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    longer = candidates.where("n_words > 2").withColumn("words", words).select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    order = "ORDER BY score DESC, a DESC, phrase"
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = rows.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang, part {order})")).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})").cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
