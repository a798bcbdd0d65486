"""Split each key's packets into flows.

Datagrams take built-in running values (``datagrams``). A TCP packet's flow depends on all earlier packets of its key
through the state machines, so keys are the unit of work: one exchange on the key, one sort on arrival order, one pass in
constant memory.  That alone would put a key holding a third of
the rows into one task.  Such hot keys are cut into chunks by arrival number instead:

1. ``hot_keys`` counts the packets of each key once and finds those above ``HOT_ROWS``, a fixed number.
2. ``_chunk_entries``: every chunk of a hot key is summarised independently, for all states it may be
   entered with; the short list of summaries is then chained per key and gives each chunk its real entry.
   A summary is bounded; where it can't tell (a clock ran far ahead and a flow closed meanwhile), the chain goes on
   with a guess, and all such chunks are followed at once from the entries they seem to have. A chunk forgets its
   entry soon, so a few of these rounds settle the guesses. Keys that ``ROUNDS`` leave unsettled are followed from
   their first open chunk, each in one pass in constant memory.
3. The final pass treats (key, chunk) as its group; a chunk starts from its entry row, which sorts first.

No packet row is collected, dropped or capped on either path, and both give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions import folds, tracking
from flowloom.functions.folds import LABELS, chain, enter, go_through, label, summarise
from flowloom.functions.tracking import HEAD_LIMIT, UDP_SYMBOL
from flowloom.operators.datagrams import label_datagrams
from flowloom.operators.packets import KEY, TCP, UDP, canonical
from flowloom.session import new_path, shared_folder

# executors need no copy of the package: the task-side helpers travel with the job
register_pickle_by_value(folds)
register_pickle_by_value(tracking)

# Limits in microseconds.
FLOW_TIMEOUT = 600_000_000
IDLE_THRESHOLD = 1_000_000

HOT_ROWS = 4_000_000
#: Up to this many hot keys (at least HOT_ROWS packets each) are broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 200_000
CHUNK_SPAN = 4_000_000
#: Rounds in which chunks are followed from the entries they seem to have.
ROUNDS = 6

_MINIMA = T.ArrayType(T.LongType())
# JSON text: a nullable struct column is slow to hand to Python when almost every row is NULL
_ENTRY = T.StringType()
_SUMMARY = T.StructType([
    T.StructField("head", _MINIMA), T.StructField("head_top", T.LongType()), T.StructField("opened", _ENTRY),
    T.StructField("synced", T.BooleanType()),
    T.StructField("lane_track", T.ArrayType(T.IntegerType())),
    T.StructField("lane_pair", T.ArrayType(T.IntegerType())),
    T.StructField("states", T.ArrayType(_MINIMA)),
])


def symbol() -> Column:
    return (F.when(F.col("proto") == TCP, F.col("side") * 64 + F.col("flags").bitwiseAND(F.lit(63)))
            .otherwise(UDP_SYMBOL).cast("smallint"))


def hot_keys(packets: DataFrame, within: Sequence[str] = (), hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows; None without any.  One count over the packets' keys.

    The table has at most one row for every ``hot_rows`` packets.  It is marked for broadcast while its size,
    which is known here, is below ``BROADCAST_KEYS``.
    """
    shared_folder(packets.sparkSession)
    key = [*within, *KEY]
    found = (canonical(packets).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
             .filter(F.col("n") > hot_rows).select(*key).checkpoint())
    count = found.count()
    if not count:
        return None
    return F.broadcast(found) if count <= BROADCAST_KEYS else found


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _ranked(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """One exchange on the group and one sort on arrival order; ``rank`` 1 marks a group's first row."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("num")))


def _chunk_entries(hot: DataFrame, key: Sequence[str], timeout: int, idle: int,
                   head_limit: int = HEAD_LIMIT) -> DataFrame:
    """State on entry of each chunk of the hot keys (every chunk but a key's first)."""
    group = [*key, "chunk"]
    chunks = hot.groupBy(*group).agg(F.max("ts_us").alias("top"))
    before = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    peaks = (chunks.select(*group, F.max("top").over(before).alias("peak"))
             .filter("peak is not null").withColumn("num", F.lit(-1).cast("bigint")))
    rows = hot.select(*group, "num", "ts_us", "side", "symbol", "len").unionByName(peaks, allowMissingColumns=True)
    rows = rows.fillna(0, ["ts_us", "side", "symbol", "len"])
    fields = {f.name: f.dataType for f in hot.schema}
    named = T.StructType([T.StructField(n, fields[n]) for n in group])
    summary = T.StructType(named.fields + _SUMMARY.fields)
    entry = T.StructType(named.fields + [T.StructField("entry", _ENTRY), T.StructField("stuck", T.BooleanType())])
    leaving = T.StructType(named.fields + [T.StructField("taken", _ENTRY), T.StructField("leaves", _ENTRY)])
    summaries = _ranked(rows, group).mapInArrow(
        summarise(key, timeout, idle, _arrow_schema(summary), head_limit), summary).persist(StorageLevel.MEMORY_AND_DISK)
    packet = [*group, "num", "ts_us", "side", "symbol", "len"]

    def after_entries(begun: DataFrame, chosen: DataFrame) -> DataFrame:
        """The ``chosen`` packets behind rows that hold the state they are entered with."""
        start = begun.select(*group, "entry").withColumn("num", F.lit(-1).cast("bigint"))
        return chosen.select(*packet).unionByName(start, allowMissingColumns=True).fillna(0, ["ts_us", "side", "symbol", "len"])

    known = None
    try:
        for last in (*[False] * ROUNDS, True):
            told = (summaries.join(known, group, "left") if known is not None else
                    summaries.withColumns({n: F.lit(None).cast(_ENTRY) for n in ("taken", "leaves")}))
            entries = (told.repartition(*key).sortWithinPartitions(*group)
                       .mapInArrow(chain(key, timeout, idle, _arrow_schema(entry)), entry).checkpoint())
            stuck = entries.filter("stuck")
            if stuck.isEmpty():
                return entries.drop("stuck")
            if last:
                break
            # each with the state it seems to be entered with, all at once
            through = after_entries(stuck, hot.join(stuck.select(*group), group, "left_semi"))
            more = _ranked(through, group).mapInArrow(go_through(key, timeout, idle, _arrow_schema(leaving)), leaving)
            known = (more if known is None else more.unionByName(known.join(stuck.select(*group), group, "left_anti"))).checkpoint()
    finally:
        summaries.unpersist()
    # what the first stuck chunk of a key is entered with is certain; the key is followed from there in one pass
    first = F.min(F.struct("chunk", "entry"))
    begun = stuck.groupBy(*key).agg(first.alias("f")).select(*key, "f.*").checkpoint()
    bound = begun.select(*key, F.col("chunk").alias("_from"))
    rest = after_entries(begun, hot.join(bound, key).filter("chunk >= _from"))
    followed = _ranked(rest, key).mapInArrow(enter(key, timeout, idle, _arrow_schema(entry)), entry)
    sure = entries.join(bound, key, "left").filter("_from is null or chunk < _from").select(*entries.columns)
    return sure.unionByName(followed).drop("stuck").checkpoint()


def segment(packets: DataFrame, within: Sequence[str] = (), timeout: int = FLOW_TIMEOUT,
            idle: int = IDLE_THRESHOLD, hot_rows: int | None = HOT_ROWS,
            chunk_span: int = CHUNK_SPAN, head_limit: int = HEAD_LIMIT, only: int | None = None) -> DataFrame:
    """Accepted packets with the flow they belong to. ``only`` one protocol's packets, or all.

    ``within`` names extra grouping columns (a capture id, a capture window): flows never span them.
    Looking for hot keys runs a counting job over the packets; ``hot_rows=None`` skips it, for groups that are
    bounded anyway.

    Adds ``flow_start`` (arrival number of the flow's first packet; with the key it identifies the flow),
    ``front`` (side that opened it), ``gap`` to the previous packet, ``iat`` to the previous packet of the
    same direction in the same burst, ``span`` of the burst that ended before this packet, ``burst`` start and
    ``burst_no``, ``client_ready``, ``closes``, and the minima so far.  A row with ``expires`` carries no packet: it says
    that its flow ended by timeout.
    """
    shared_folder(packets.sparkSession)
    key = [*within, *KEY]
    # the key and the side give the endpoints back, so they needn't go through the exchange
    keyed = canonical(packets).withColumn("symbol", symbol()).drop("srcip", "srcport", "dstip", "dstport")
    hot = None if hot_rows is None else hot_keys(packets, within, hot_rows)
    if hot is None:
        marked = keyed.withColumns({"chunk": F.lit(0).cast("bigint"), "hot": F.lit(False)})
    else:
        kept = keyed if only is None else keyed.filter(F.col("proto") == TCP if only == TCP else F.col("proto") != TCP)
        marked = _marked(kept, key, hot, chunk_span)
    datagrams = _datagrams(marked.filter(F.col("proto") != TCP), key, hot is not None, timeout, idle)
    if only == UDP:
        return datagrams
    streams = _streams(marked.filter(F.col("proto") == TCP), key, hot is not None, timeout, idle, head_limit)
    return streams if only == TCP else streams.unionByName(datagrams)


def _marked(keyed: DataFrame, key: Sequence[str], hot: DataFrame, chunk_span: int) -> DataFrame:
    """The packets with ``hot`` and their ``chunk`` (0 for other keys), stored: hot keys are read several times, and a
    filter on a key that is computed would compute it anew for each condition."""
    number = F.call_function("div", F.col("num"), F.lit(chunk_span))
    marked = keyed.join(hot.withColumn("hot", F.lit(True)), key, "left").withColumns({
        "chunk": F.when(F.col("hot"), number).otherwise(0).cast("bigint"), "hot": F.coalesce("hot", F.lit(False))})
    path = new_path(keyed.sparkSession, "packets")
    marked.write.parquet(path)
    return keyed.sparkSession.read.schema(marked.schema).parquet(path)


def _datagrams(marked: DataFrame, key: Sequence[str], cut: bool, timeout: int, idle: int) -> DataFrame:
    """All keys but the hot ones as one window each, the hot ones in stretches."""
    whole = label_datagrams(marked.filter(~F.col("hot")).drop("hot"), key, timeout, idle)
    if not cut:
        return whole
    return whole.unionByName(label_datagrams(marked.filter("hot").drop("hot"), key, timeout, idle, cut=True))


def _streams(marked: DataFrame, key: Sequence[str], cut: bool, timeout: int, idle: int, head_limit: int) -> DataFrame:
    if not cut:
        rows = marked.drop("hot").withColumn("entry", F.lit(None).cast(_ENTRY))
    else:
        entries = _chunk_entries(marked.filter("hot").drop("hot"), key, timeout, idle, head_limit).withColumn(
            "num", F.lit(-1).cast("bigint"))
        rows = marked.drop("hot").unionByName(entries, allowMissingColumns=True).fillna(
            0, ["ts_us", "side", "symbol", "len"])
    ranked = _ranked(rows, [*key, "chunk"])
    kept = [f for f in ranked.schema.fields if f.name not in ("rank", "entry")]
    out = T.StructType(kept + [T.StructField(n, T.StructType.fromDDL(f"x {t}")[0].dataType) for n, _, t in LABELS])
    return ranked.mapInArrow(label(timeout, idle), out)
