r"""Chat formatting over reply trees.

Messages form trees: every message has an id and the id of the message it answers. Root-to-leaf paths are found by
iterative self-joins with path doubling (round k joins every message with its ancestor 2^k steps up, so a chain of n turns
takes log2(n) rounds), branches are ranked by the mean score of their messages, and every chosen path is formatted as one
conversation by the template below. Only DataFrame operations are used.

Template. A turn is ``### Label: text</turn>\n``. In texts and labels a backslash is put before every backslash, inside
``</turn>`` after its ``<``, and after a ``#`` that two more follow, so neither control string can occur in escaped text;
in labels a colon is escaped too. Dropping every backslash that introduces another character gives the text back.

Defined cases. A null text or role counts as empty, a null score as 0. A message whose parent is null, itself or absent is a root.
Messages on a cycle have no root and make no path. Ties in the ranking go to the smaller leaf id. Further columns
of the input are ignored; an empty table gives an empty result. Repeated rows are separate messages only if their
ids differ (``from_turns`` gives every row an id of its own).

Sizes. The self-joins move only ids and scores. A conversation's text is gathered into one row because that row is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from timeloom.llm.common import stage, table

#: The labels of the usual roles.
LABELS = {"user": "User", "assistant": "Assistant", "system": "System"}
OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    t = F.regexp_replace(text, r"\\", r"\\\\")
    t = F.regexp_replace(t, "<(?=/turn>)", r"<\\")
    return F.regexp_replace(t, "#(?=##)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def label(role: Column) -> Column:
    """``user`` becomes ``User`` and so on; another role stands as it is, marked by ``@``."""
    out = F.concat(F.lit("@"), F.regexp_replace(escape(role), ":", r"\\:"))
    for name, shown in LABELS.items():
        out = F.when(role == name, F.lit(shown)).otherwise(out)
    return out


def role_of(shown: Column) -> Column:
    out = unescape(F.substring(shown, 2, 1 << 30))
    for name, text in LABELS.items():
        out = F.when(shown == text, F.lit(name)).otherwise(out)
    return out


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, as array<struct<role, text>>."""
    turns = F.filter(F.split(formatted, CLOSE, -1), lambda t: t != "")
    head = r"(?s)^### ((?:\\.|[^\\:])*): "
    return F.transform(
        turns,
        lambda t: F.struct(
            role_of(F.regexp_extract(t, head, 1)).alias("role"),
            unescape(F.regexp_replace(t, head, "")).alias("text"),
        ),
    )


def from_turns(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) as reply chains: every row answers the one before it in its conversation.

    Rows are ordered by turn, then role and text, so equal turn numbers are no hazard. Null turns come first.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", "turn", "role", "text", F.row_number().over(order).cast("long").alias("node")).select(
        F.col("conv_id").alias("tree"),
        "node",
        F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
        "role",
        "text",
        F.lit(1.0).alias("score"),
    )


def format_trees(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """messages: tree, node (unique in its tree), parent, role, text, score. best: paths kept per tree, None for all.

    Returns tree, leaf, rank, score (mean over the path), n_turns, formatted, loss (array<struct<start, length>> of the
    assistant texts, in code points from 0, as they stand in ``formatted``).
    """
    m = messages.select(
        "tree",
        F.col("node").cast("long").alias("node"),
        F.col("parent").cast("long").alias("parent"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )
    m = stage(m, "chat-messages")
    tree = lambda a, b: F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))
    ids = m.select("tree", "node")
    known = m.alias("m").join(ids.alias("p"), tree("m", "p") & (F.col("m.parent") == F.col("p.node")) & (F.col("m.parent") != F.col("m.node")), "left")
    # up: the ancestor 2^k steps above, null beyond the root; n and total: messages and score from here to below it
    at = stage(known.select("m.tree", "m.node", F.col("p.node").alias("up"), F.lit(1).cast("long").alias("n"), F.col("m.score").alias("total")), "chat-up")
    leaves = ids.alias("m").join(at.alias("c"), tree("m", "c") & (F.col("m.node") == F.col("c.up")), "left_anti")
    done, going = at.where(F.col("up").isNull()), at.where(F.col("up").isNotNull())
    jumps, limit = [], max(1, at.count()).bit_length() + 1
    while going.limit(1).count() and len(jumps) < limit:
        jumps.append(going)
        # only messages that have not reached their root are joined again
        both = going.alias("a").join(going.unionByName(done).alias("b"), tree("a", "b") & (F.col("a.up") == F.col("b.node")))
        at = stage(both.select("a.tree", "a.node", F.col("b.up").alias("up"), (F.col("a.n") + F.col("b.n")).alias("n"), (F.col("a.total") + F.col("b.total")).alias("total")), "chat-up")
        done, going = done.unionByName(at.where(F.col("up").isNull())), at.where(F.col("up").isNotNull())
    ranked = (
        leaves.alias("l")
        .join(done.alias("d"), tree("l", "d") & (F.col("l.node") == F.col("d.node")))
        .select("d.tree", F.col("d.node").alias("leaf"), "n", (F.col("total") / F.col("n")).alias("path_score"))
        .withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")))
    )
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    ranked = stage(ranked, "chat-ranked")
    # every distance from the leaf is a sum of distinct powers of two, so each round at most doubles what has been reached
    path = ranked.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(jumps))):
        hop = path.alias("p").join(jumps[k].alias("j"), tree("p", "j") & (F.col("p.node") == F.col("j.node")))
        path = path.unionByName(hop.select("p.tree", "p.leaf", F.col("j.up").alias("node"), (F.col("p.above") + (1 << k)).alias("above")))
        if k % 2 == 0:
            path = stage(path, "chat-path")
    turn = F.concat(F.lit(OPEN), label(F.col("m.role")), F.lit(MID))
    turns = (
        path.alias("p")
        .join(m.alias("m"), tree("p", "m") & (F.col("p.node") == F.col("m.node")))
        .select("p.tree", "p.leaf", F.struct((-F.col("p.above")).alias("at"), turn.alias("head"), escape(F.col("m.text")).alias("body"), (F.col("m.role") == "assistant").alias("own")).alias("turn"))
    )
    made = turns.groupBy("tree", "leaf").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    size = lambda t: (F.length(t["head"]) + F.length(t["body"]) + len(CLOSE)).cast("long")
    start = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("loss"))
    spans = F.aggregate(
        "turns",
        start,
        lambda a, t: F.struct(
            (a["end"] + size(t)).alias("end"),
            F.when(t["own"], F.concat(a["loss"], F.array(F.struct((a["end"] + F.length(t["head"])).cast("long").alias("start"), F.length(t["body"]).cast("long").alias("length"))))).otherwise(a["loss"]).alias("loss"),
        ),
        lambda a: a["loss"],
    )
    made = made.select("tree", "leaf", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"), spans.alias("loss"))
    return made.alias("f").join(ranked.alias("r"), tree("f", "r") & (F.col("f.leaf") == F.col("r.leaf"))).select("f.tree", "f.leaf", "r.rank", F.col("r.path_score").alias("score"), "f.n_turns", "f.formatted", "f.loss")


#: A conversation whose texts hold control strings and a backslash; the contract adds it to the table.
PLANTED = "\\### Assistant: </turn> ok"


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    made = format_trees(from_turns(rows.unionByName(extra)), best=None)
    back = made.withColumn("turns", parse(F.col("formatted"))).withColumn("masked", F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        digest.alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
    + 14 + CASE role WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'system' THEN 6 ELSE length(role) + 1 END AS chars
  FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
