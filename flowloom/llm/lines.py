"""Line deduplication with a tree of log templates.

The tree has a fixed depth: lines part by their number of tokens, then by their leading tokens, where a token with a
digit is a variable field. At a leaf, the commonest token at each position that several different lines share makes
a template of the leaf; lines that agree with it at ``SIMILARITY`` of their positions or more belong to it, and what
differs is a further variable field. The lines it leaves are parted by their token at one more position, that with the
fewest different tokens, and each part makes a template of its own, until no two lines are left together. Other lines
are a template of their own, their variable fields generalised. A template found in several documents is dropped
from all but the one with the smallest doc_id. All steps are joins and aggregations, so no line waits for another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import stored

DEPTH = 3
MIN_TOKENS = 3
SIMILARITY = 0.8
#: Up to this many leaves with several forms are broadcast (8 bytes each); beyond, the lines are joined by a shuffle.
BROADCAST_LEAVES = 2_000_000
FIELD = "<*>"
_WHITE = r"[\x20\x09-\x0D]+"
# a match begins where a token does, so no token is scanned twice
_WITH_DIGIT = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
_PLAIN = r"[0-9\x09\x0B-\x0D]"
_TRIM = " \t\x0b\x0c\r"
_SPLIT_LINES = "\n"


def _masked(line: Column) -> Column:
    """A line with single spaces between its tokens, those with a digit generalised."""
    blank = F.lit(" ")
    odd = line.rlike(_PLAIN) | line.contains("  ") | line.startswith(blank) | line.endswith(blank)
    clean = F.btrim(F.regexp_replace(F.regexp_replace(line, _WITH_DIGIT, FIELD), _WHITE, " "), F.lit(_TRIM))
    return F.when(odd, clean).otherwise(line)


def _parsed(documents: DataFrame) -> DataFrame:
    """A row for each line with enough tokens: doc_id, version, line number, and where the line goes in the tree."""
    # the hash of a text is taken before its lines are dealt out, so once for each document
    whole = documents.select("doc_id", "text", F.xxhash64("text").alias("version"))
    lines = whole.select("doc_id", "version", F.posexplode(F.split("text", _SPLIT_LINES)).alias("line", "content"))
    masked = lines.select("doc_id", "version", "line", _masked(F.col("content")).alias("masked"))
    size = F.octet_length("masked") - F.octet_length(F.replace("masked", F.lit(" "), F.lit(""))) + 1
    counted = masked.withColumn("size", size).where(F.col("size") >= MIN_TOKENS)
    return counted.select(
        "doc_id", "version", "line", "masked",
        F.xxhash64("size", F.substring_index("masked", " ", DEPTH)).alias("leaf"),
        # 128 bits stand for the generalised line
        F.xxhash64("masked").alias("form"), F.xxhash64(F.lit("form"), "masked").alias("form_2"))


def _span() -> list[Column]:
    """The documents that rows stand in: smallest and largest id, and whether any is without."""
    return [F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
            F.max(F.col("doc_id").isNull()).alias("nameless")]


def _similar(lines: DataFrame, forms: DataFrame, similarity: float, broadcast_leaves: int) -> DataFrame | None:
    """The lines' forms that belong to a template, its number and the documents they span; None if no leaf has two forms.

    Each round makes one template for every node of the tree and parts the lines that it leaves, so there are at most as
    many rounds as a line has tokens.
    """
    several = forms.groupBy("leaf").count().where("count > 1").select("leaf").checkpoint()
    leaves = several.count()
    if not leaves:
        return None
    several = F.broadcast(several) if leaves <= broadcast_leaves else several
    key, found, number = ["leaf", "form", "form_2"], None, 0
    left = lines.join(several, "leaf", "left_semi").groupBy(*key).agg(
        *_span(), F.min("masked").alias("masked")).select(
        *key, "first", "last", "nameless", F.col("leaf").alias("node"), F.split("masked", " ").alias("tokens")).checkpoint()
    while True:
        seen = left.select("node", F.posexplode("tokens").alias("place", "token")).groupBy(
            "node", "place", "token").agg(F.count(F.lit(1)).alias("n"))
        common = seen.groupBy("node", "place").agg(F.max(F.struct("n", "token")).alias("top"), F.count(F.lit(1)).alias("different"))
        templates = common.groupBy("node").agg(
            F.sort_array(F.collect_list(F.struct("place", F.when(F.col("top.n") > 1, F.col("top.token")).alias("token")))).alias("template"),
            F.min(F.when((F.col("different") > 1) & (F.col("top.n") > 1), F.struct("different", "place")))["place"].alias("part"))
        agree = F.size(F.filter(F.zip_with(
            "tokens", "template", lambda a, b: F.coalesce(a == b["token"], F.lit(False))), lambda same: same))
        judged = left.join(templates, "node").withColumn("taken", agree >= similarity * F.size("tokens")).drop("template").checkpoint()
        taken = judged.where("taken").select(*key, "first", "last", "nameless", F.xxhash64("node", F.lit(number)).alias("template"))
        found = taken if found is None else found.union(taken)
        parted = judged.where("not taken and part is not null").withColumn(
            "node", F.xxhash64("node", "part", F.get("tokens", F.col("part")))).drop("part", "taken")
        together = parted.groupBy("node").count().where("count > 1").select("node")
        left = parted.join(together, "node", "left_semi").select(left.columns).checkpoint()
        if left.isEmpty():
            return found
        number += 1


def recurring_lines(documents: DataFrame, similarity: float = SIMILARITY,
                    broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """The lines of ``documents`` (doc_id, text) to drop: doc_id, version, dropped (their numbers, from 0).

    ``version`` is the hash of the text (``xxhash64``). Only hashes and numbers are exchanged, and the text of lines
    whose leaf several forms share; the parsed lines are written once, so each text is split and generalised once.
    """
    lines = stored(_parsed(documents), "lines", "zstd")
    key = ["leaf", "form", "form_2"]
    forms = stored(lines.groupBy(*key).agg(*_span()), "forms")
    recurs = "first < last or (nameless and first is not null)"
    similar = _similar(lines, forms, similarity, broadcast_leaves)
    if similar is None:
        recurring = forms.where(recurs).select(*key, "first")
    else:
        own = forms.where(recurs).join(similar.select(*key), key, "left_anti")
        template = similar.groupBy("template").agg(F.min("first").alias("first"), F.max("last").alias("last"),
                                                   F.max("nameless").alias("nameless")).where(recurs)
        recurring = own.select(*key, "first").union(
            similar.select(*key, "template").join(template, "template").select(*key, "first"))
    return lines.drop("masked").join(recurring, key).where("doc_id is null or doc_id > first").groupBy("doc_id", "version").agg(
        F.collect_set("line").alias("dropped"))


def kept_text(text: Column, dropped: Column) -> Column:
    """``text`` without the lines whose numbers are in ``dropped``, which isn't NULL."""
    def joined(split: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), dropped)
        return F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n")

    # an array of one, so that the text is split once and not for each line
    return F.transform(F.array(F.split(text, _SPLIT_LINES)), joined)[0]


def drop_recurring(documents: DataFrame, similarity: float = SIMILARITY,
                   broadcast_leaves: int = BROADCAST_LEAVES) -> DataFrame:
    """``documents`` (doc_id, text) without recurring lines: doc_id, text, n_lines, n_dropped.

    Lines under ``MIN_TOKENS`` tokens are kept. A text that loses all its lines is empty. NULL text stays NULL, with
    no lines. A row without doc_id comes after all others, so it keeps only lines that no document with an id has. Rows
    that are equal in doc_id and text count as one document, and each is returned.
    """
    dropped = recurring_lines(documents, similarity, broadcast_leaves).select(
        F.col("doc_id").alias("_doc_id"), F.col("version").alias("_version"), "dropped")
    whole = documents.select("doc_id", "text", F.xxhash64("text").alias("version"))
    joined = whole.join(dropped, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("version") == F.col("_version")),
                        "left")
    return joined.select(
        "doc_id", F.when(F.col("dropped").isNull(), F.col("text")).otherwise(
            kept_text(F.col("text"), F.col("dropped"))).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", _SPLIT_LINES))).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


_ROUNDS = 8
#: One round of the tree in SQL: m is what goes in, y what the nodes' templates take, and the next m what is parted.
_ROUND = """
c{r} as materialized (
  select node, place, token, count(*) as k
  from (select node, unnest(range(n)) as place, unnest(tokens) as token from m{r}) group by all),
r{r} as (
  select node, place, arg_max(token, (k, token)) as token, max(k) as k, count(*) as different from c{r} group by all),
d{r} as materialized (
  select node, list(case when k > 1 then token end order by place) as template,
    arg_min(place, (different, place)) filter (where different > 1 and k > 1) as part
  from r{r} group by node),
j{r} as materialized (
  select m{r}.*, part, len(list_filter(range(n), lambda i: tokens[i + 1] = template[i + 1])) >= 0.8 * n as taken
  from m{r} join d{r} using (node)),
p{r} as materialized (
  select n, tokens, first, last, hash(node, part, tokens[part + 1]) as node from j{r} where not taken and part is not null),
m{s} as materialized (select * from p{r} where node in (select node from p{r} group by node having count(*) > 1)),"""

ORACLE = r"""
with l as (
  select doc_id, text, unnest(range(len(string_split(text, chr(10))))) as line, string_split(text, chr(10)) as split
  from documents where text is not null),
t as (
  select doc_id, line, string_split_regex(trim(regexp_replace(split[line + 1],
    '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), ' ' || chr(9) || chr(11) || chr(12) || chr(13)),
    '[\x20\x09-\x0D]+') as tokens
  from l),
p as (select doc_id, line, tokens, len(tokens) as n, tokens[1:3] as head from t where len(tokens) >= 3),
f as (select n, head, tokens, min(doc_id) as first, max(doc_id) as last from p group by all),
s as (select n, head from f group by n, head having count(*) > 1),
m0 as (select n, tokens, first, last, hash(n, head) as node from f join s using (n, head)),""" + "".join(_ROUND.format(r=r, s=r + 1) for r in range(_ROUNDS)) + " y as materialized (" + " union all ".join(
    f"select tokens, first, last, hash(node, {r}) as template from j{r} where taken" for r in range(_ROUNDS)) + r"""),
g as (select template, min(first) as first, max(last) as last from y group by template),
w as (
  select tokens, g.first, g.last from y join g using (template)
  union all
  select tokens, first, last from f where tokens not in (select tokens from y)),
x as (
  select p.doc_id, list(p.line) as dropped from p join w using (tokens)
  where w.first < w.last and p.doc_id > w.first group by p.doc_id)
select doc_id,
  case when dropped is null then text else coalesce(array_to_string(list_transform(list_filter(
    range(len(string_split(text, chr(10)))), lambda i: not list_contains(dropped, i)),
    lambda i: string_split(text, chr(10))[i + 1]), chr(10)), '') end as text,
  case when text is null then 0 else len(string_split(text, chr(10))) end::bigint as n_lines,
  coalesce(len(dropped), 0)::bigint as n_dropped
from documents left join x using (doc_id)"""
