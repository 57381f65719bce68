"""Chat formatting as a prefix tree: shared initial turns are emitted once.

A node of the tree is a turn with all turns before it; conversations that start alike share
nodes.  A node belongs to the smallest conversation through it, so the nodes of a conversation's
own are the end of it, its *chain*.  Depth-first order puts a chain in one piece, then the chains
that branch off it, deepest branch first.  A tree's tokens are numbered in that order
(``start``), positions follow the conversation (``position``), and a token sees its own chain up
to itself and, of each chain above, the part before the branch (``sees``, intervals of
token numbers).  So one packed sequence trains all conversations of a tree.

The template of a turn is ``<s>role\\ntext</s>``.  ``<s>`` and ``</s>`` are ids of their own above
the vocabulary.  In roles and texts ``\\`` becomes ``\\S``, ``<`` ``\\L`` and ``[`` ``\\B``, so no
control string, ``[INST]`` and the like included, can occur; in roles a line feed becomes ``\\N``.

Turns are numbered and summed up by (conversation, lane of turns), never by a window over a whole
conversation; equal prefixes are found by keys of 120 bits, exclusive or-ed over the turns.

Defined cases: null texts and roles are empty; turns are ordered by turn (nulls first), then
role, then text, so ties and repeated rows are turns of their own; rows with a null conversation
are one conversation (``NULL_CONVERSATION`` inside); an empty table gives empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from screenlake.llm.arrow import parts
from screenlake.llm.byte_bpe import Codec, read_ranks
from screenlake.session import cut_lineage

OPEN, CLOSE = "<s>", "</s>"
#: The loss is on these roles' texts.
LEARNED = ("assistant",)
LANE = 256
NULL_CONVERSATION = -(2**63)
_KEPT = 64


def escaped(text: Column) -> Column:
    for plain, mark in (("\\", "\\S"), ("<", "\\L"), ("[", "\\B")):
        text = F.replace(text, F.lit(plain), F.lit(mark))
    return text


def unescaped(text: str) -> str:
    return text.replace("\\N", "\n").replace("\\L", "<").replace("\\B", "[").replace("\\S", "\\")


def _ordered(turns: DataFrame) -> DataFrame:
    """(conv, idx, lane, role, text): the turns of each conversation numbered from 0."""
    rows = turns.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NULL_CONVERSATION)).alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("lane", F.floor(F.col("turn") / LANE).cast("bigint"))
    starts = _before(rows.groupBy("conv", "lane").agg(F.count("*").alias("n")), ["n"])
    within = Window.partitionBy("conv", "lane").orderBy("turn", "role", "text")
    numbered = rows.withColumn("at", F.row_number().over(within) - 1)
    return numbered.join(starts, (numbered.conv == starts.c) & numbered.lane.eqNullSafe(starts.l)).select("conv", (F.col("n_before") + F.col("at")).cast("bigint").alias("idx"), "role", "text")


def _before(lanes: DataFrame, names: list[str], how=F.sum) -> DataFrame:
    """For each (conv, lane), here c and l, the sums of the lanes before it."""
    earlier = Window.partitionBy("conv").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    return lanes.select(F.col("conv").alias("c"), F.col("lane").alias("l"), *[F.coalesce(how(n).over(earlier), F.lit(0)).alias(f"{n}_before") for n in names])


def _running(rows: DataFrame, values: dict[str, Column], how, inclusive: bool) -> DataFrame:
    """``rows(conv, idx, ...)`` with running values over each conversation, lane by lane."""
    rows = rows.withColumn("lane", F.floor(F.col("idx") / LANE).cast("bigint")).withColumns({f"{n}_own": v for n, v in values.items()})
    before = _before(rows.groupBy("conv", "lane").agg(*[how(f"{n}_own").alias(n) for n in values]), list(values), how)
    within = Window.partitionBy("conv", "lane").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    inside = rows.withColumns({n: F.coalesce(how(f"{n}_own").over(within), F.lit(0)) for n in values})
    joined = inside.join(before, (F.col("conv") == F.col("c")) & (F.col("lane") == F.col("l")))
    add = (lambda a, b: a.bitwiseXOR(b)) if how is F.bit_xor else (lambda a, b: a + b)
    kept = [c for c in rows.columns if c != "lane" and not c.endswith("_own")]
    return joined.select(*kept, *[add(F.col(n), F.col(f"{n}_before")).alias(n) for n in values])


def _coded(nodes: DataFrame, data: bytes, pattern: str) -> DataFrame:
    """``nodes(conv, idx, role, text)`` with their token ids and where the text's tokens lie."""
    mark = max(read_ranks(data).values()) + 1
    first, last = (np.array([m], "<u4").tobytes() for m in (mark, mark + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(data, pattern)
        for batch in parts(batches):
            heads = [codec.encode(r + "\n") for r in batch.column(3).to_pylist()]
            bodies = [codec.encode(t) for t in batch.column(4).to_pylist()]
            ids = [first + h + b + last for h, b in zip(heads, bodies, strict=True)]
            columns = [[len(x) // 4 for x in ids], [1 + len(h) // 4 for h in heads], [1 + (len(h) + len(b)) // 4 for h, b in zip(heads, bodies, strict=True)]]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(ids, pa.binary()), *(pa.array(c, pa.int64()) for c in columns)], names=["conv", "idx", "role", "ids", "n_tokens", "text_from", "text_to"])

    plain = nodes.select("conv", "idx", "role", F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\N")).alias("r"), escaped(F.col("text")).alias("t"))
    return plain.mapInArrow(run, "conv long, idx long, role string, ids binary, n_tokens long, text_from long, text_to long")


def _digits(text: Column, at: int) -> Column:
    return F.conv(F.substring(text, at, 15), 16, 10).cast("bigint")


def prefix_tree(turns: DataFrame, path: str, pattern: str, learned: tuple[str, ...] = LEARNED) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trees, and the conversations as paths through them.

    ``turns`` has conv_id, turn, role, text.  Nodes: (tree, chain, depth, role, loss, ids, n_tokens,
    text_from, text_to, start, position, sees); the ids are little-endian unsigned 32-bit integers.
    Conversations: (conv_id, tree, n_turns, path), where path lists (depth, chain): from this depth
    on, the turns are the nodes of this chain."""
    with open(path, "rb") as file:
        data = file.read()
    spark = turns.sparkSession
    ordered = cut_lineage(_ordered(turns))
    digest = F.md5(F.concat(F.col("idx").cast("string"), F.lit(":"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    keyed = _running(ordered.select("conv", "idx", digest.alias("d")), {"k1": _digits(F.col("d"), 1), "k2": _digits(F.col("d"), 16)}, F.bit_xor, True)
    keyed = cut_lineage(keyed.select("conv", "idx", "k1", "k2"))
    owners = keyed.groupBy("idx", "k1", "k2").agg(F.min("conv").alias("owner"))
    owned = cut_lineage(keyed.join(owners, ["idx", "k1", "k2"]).select("conv", "idx", "owner"))

    mine = owned.where("conv = owner").select("conv", "idx")
    coded = cut_lineage(_coded(ordered.join(mine, ["conv", "idx"]), data, pattern))
    sizes = coded.select(F.col("conv").alias("owner"), "idx", "n_tokens")
    placed = _running(owned.join(sizes, ["owner", "idx"]), {"position": F.col("n_tokens")}, F.sum, False).where("conv = owner").select("conv", "idx", "position")
    coded = cut_lineage(coded.join(placed, ["conv", "idx"]))

    steps = owned.groupBy("conv", "owner").agg(F.min("idx").alias("depth"), F.count("*").alias("n"))
    # a step stands for another conversation that goes its own way there, so paths stay short
    paths = cut_lineage(steps.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", F.col("owner").alias("chain")))).alias("path"), F.sum("n").alias("n_turns")))
    chains = coded.groupBy("conv").agg(F.sum("n_tokens").alias("size"), F.min("position").alias("from"))
    order = F.transform("path", lambda s: F.struct((-s["depth"]).alias("d"), s["chain"].alias("c")))
    chains = chains.join(paths, "conv").select("conv", "size", "from", "path", F.col("path")[0]["chain"].alias("tree"), order.alias("order"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(chains.repartitionByRange(n, "tree", "order").withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("tree", "part").agg(F.sum("size").alias("total"))
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("tree", "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("tree", "part").orderBy("order").rowsBetween(Window.unboundedPreceding, -1)
    started = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["tree", "part"])
    started = cut_lineage(started.select("conv", "tree", "path", "from", (F.col("offset") + F.col("inside")).alias("start")))

    # of each chain above: from its start to where the next chain of the path branches off
    above = started.select("conv", F.posexplode("path").alias("step", "at"), F.size("path").alias("steps")).select("conv", "step", F.col("at.chain").alias("chain"), F.col("steps") - 1 > F.col("step"))
    above = above.toDF("conv", "step", "chain", "above").join(started.select(F.col("conv").alias("chain"), F.col("start").alias("s"), F.col("from").alias("f")), "chain")
    ahead = above.select("conv", (F.col("step") - 1).alias("step"), F.col("f").alias("next"))
    sees = above.where("above").join(ahead, ["conv", "step"]).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct(F.col("s").alias("begin"), (F.col("s") + F.col("next") - F.col("f")).alias("end")))).alias("above"))
    started = started.join(sees, "conv", "left")

    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    start = F.col("start") + F.col("position") - F.col("from")
    own = F.array(F.struct(F.col("start").alias("begin"), (start + F.col("n_tokens")).alias("end")))
    conv_id = F.nullif(F.col("conv"), F.lit(NULL_CONVERSATION))
    nodes = coded.join(started.drop("path"), "conv").select(
        "tree", F.col("conv").alias("chain"), F.col("idx").alias("depth"), "role", F.col("role").isin(*learned).alias("loss"), "ids", "n_tokens", "text_from", "text_to",
        start.alias("start"), "position", F.concat(F.coalesce("above", none), own).alias("sees"),
    )
    return nodes, paths.select(conv_id.alias("conv_id"), F.col("path")[0]["chain"].alias("tree"), "n_turns", "path")


def read_back(nodes: DataFrame, conversations: DataFrame, path: str, pattern: str) -> DataFrame:
    """What each conversation says, from the tree's tokens alone: (conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars)."""
    with open(path, "rb") as file:
        data = file.read()
    mark = max(read_ranks(data).values()) + 1
    until = F.expr("CASE WHEN step + 1 < size(path) THEN path[step + 1].depth ELSE n_turns END")
    steps = conversations.select("conv_id", "n_turns", "path", F.posexplode("path").alias("step", "at")).select("conv_id", F.col("at.chain").alias("chain"), F.explode(F.sequence(F.col("at.depth"), until - 1)).alias("depth"))
    turns = steps.join(nodes.select("chain", "depth", "loss", "ids", "text_from", "text_to"), ["chain", "depth"])
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, done = Codec.of(data, pattern), []
        now, turns_, loss, n, chars, formatted = None, hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in x else pa.int64()) for x, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

        def result() -> tuple:
            return now[0], n, turns_.hexdigest(), chars, loss.hexdigest(), formatted

        for batch in parts(batches):
            for conv, learned, ids, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if now is None or conv != now[0]:
                    if now is not None:
                        done.append(result())
                    now, turns_, loss, n, chars, formatted = (conv,), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                assert np.frombuffer(ids, "<u4")[[0, -1]].tolist() == [mark, mark + 1]
                role, text = (codec.decode(ids[4 * i : 4 * j]).decode() for i, j in ((1, a), (a, b)))
                formatted += len(OPEN) + len(role) + len(text) + len(CLOSE)
                plain = unescaped(text)
                turns_.update(f"{unescaped(role[:-1])}\n{plain}\n".encode())
                n += 1
                if learned:
                    chars += len(plain)
                    loss.update(plain.encode())
            if len(done) >= _KEPT:
                yield packed(done)
                done = []
        if now is not None:
            done.append(result())
        if done:
            yield packed(done)

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "depth").select("conv_id", "loss", "ids", "text_from", "text_to")
    return dealt.mapInArrow(run, schema)
