"""Quotation linking for chats and mail threads, with DataFrame functions only.

Lines are parsed into quote levels; runs of lines of one level, cut at blank lines, are passages. Normalised
passages (and their longer lines) are hashed and joined to the earlier message of the conversation that wrote
them unquoted. Chains of replies are followed by pointer jumping. Messages, without quotes and without the lines
that announce them, are then put in reply order: threads by their first turn, within a thread by turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written
from corpusloom.operators.ordering import running

#: Least characters of a normalised line that is matched apart from its passage.
LINE_CHARS = 20
#: Bytes of text in one row of a conversation; of more, as of all messages without a conversation, the rows follow one another.
PIECE = 16 << 20
#: What a message weighs beside its text.
MESSAGE = 64

QUOTED = r"^(?:[ \t]{0,3}>)+"
#: Fixed value: lines that announce a quote, in English, German, French and Spanish.
ANNOUNCE = r"(?i)^.{0,200}\b(?:wrote|schrieb|écrit|escribió)\b.{0,80}:[ \t]*$"

_PASSAGES = "array<struct<level:int,body:string>>"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _lines(text: Column) -> Column:
    """Lines as structs of level, body and kept (unquoted, and not the announcement of a quote)."""
    parsed = F.transform(
        F.split(text, r"\r?\n"),
        lambda line: F.struct(F.length(F.regexp_replace(F.regexp_extract(line, QUOTED, 0), "[^>]", "")).alias("level"), F.regexp_replace(line, QUOTED + r"[ \t]?", "").alias("body")),
    )
    return _let(
        parsed,
        lambda xs: F.transform(
            xs,
            lambda x, i: F.struct(
                x["level"].alias("level"),
                x["body"].alias("body"),
                ((x["level"] == 0) & ~(x["body"].rlike(ANNOUNCE) & (i + 2 <= F.size(xs)) & (F.coalesce(F.try_element_at(xs, (i + 2).cast("int"))["level"], F.lit(0)) > 0))).alias("kept"),
            ),
        ),
    )


def _passages(lines: Column) -> Column:
    """Runs of lines of one level, cut at blank lines; announcements belong to none.

    Runs are found by where they begin and end, so that each line is copied once, into its run.
    """
    told = F.transform(lines, lambda x: F.struct(F.when((F.trim(x["body"]) == "") | ((x["level"] == 0) & ~x["kept"]), F.lit(-1)).otherwise(x["level"]).alias("level"), x["body"].alias("body")))

    def runs(xs: Column) -> Column:
        level = lambda i: F.coalesce(F.try_element_at(xs, i.cast("int"))["level"], F.lit(-1))  # noqa: E731  from 1
        places = F.sequence(F.lit(1), F.size(xs))
        starts = F.filter(places, lambda i: (level(i) >= 0) & ((i == 1) | (level(F.greatest(i - 1, F.lit(1))) != level(i))))
        ends = F.filter(places, lambda i: (level(i) >= 0) & (level(i + 1) != level(i)))
        return F.zip_with(
            starts, ends, lambda a, b: F.struct(level(a).alias("level"), F.array_join(F.transform(F.slice(xs, a, b - a + 1), lambda x: x["body"]), "\n").alias("body"))
        )

    return F.coalesce(_let(told, runs), F.expr(f"cast(array() as {_PASSAGES})"))


def _plain_passages(text: Column) -> Column:
    whole = F.filter(F.split(text, r"(?:\r?\n[ \t]*)+\r?\n|^(?:[ \t]*\r?\n)+"), lambda p: F.trim(p) != "")
    return F.transform(whole, lambda p: F.struct(F.lit(0).alias("level"), p.alias("body")))


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def _message_key(*columns: str) -> Column:
    """128 bits of the columns, each behind its length; a null is told from every value."""
    told = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.unhex(F.md5(F.concat(*[F.coalesce(told(F.col(c).cast("string")), F.lit("-")) for c in columns]).cast("binary")))


def _keys(body: Column) -> Column:
    """Normalised passage, and its lines of LINE_CHARS or more, as structs of hash and length."""
    texts = F.array_distinct(F.concat(F.array(_normal(body)), F.filter(F.transform(F.split(body, r"\r?\n"), _normal), lambda x: F.length(x) >= LINE_CHARS)))
    return F.transform(F.filter(texts, lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("hash"), F.length(x).alias("chars")))


def linked(messages: DataFrame) -> DataFrame:
    """Distinct messages (conv_id, turn, role, text) with n_quoted, max_level, n_linked, reply_to, thread, depth and clean.

    reply_to is the turn that wrote the longest quoted passage of the lowest level, depth the number of replies up
    to the thread's first turn. A message that quotes nothing known, or has a null conv_id or turn, opens a
    thread of its own. A null text is empty; a text without quotes is kept as it is. Repeated rows are one
    message; a passage that several earlier turns wrote belongs to the first. Extra columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    quoting = text.rlike("(?m)" + QUOTED)
    parsed = messages.select("conv_id", "turn", "role", text.alias("text"), quoting.alias("quoting"))
    parsed = parsed.withColumn("lines", F.when(F.col("quoting"), _lines(F.col("text"))))
    clean = F.regexp_replace(F.array_join(F.transform(F.filter("lines", lambda x: x["kept"]), lambda x: x["body"]), "\n"), r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "")
    parsed = parsed.withColumn("clean", F.when(F.col("quoting"), clean).otherwise(F.col("text")))
    parsed = parsed.withColumn("passages", F.when(F.col("quoting"), _passages(F.col("lines"))).otherwise(_plain_passages(F.col("text")))).drop("lines")
    parsed = parsed.withColumn("key", _message_key("conv_id", "turn", "text"))

    written_by = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(F.filter("passages", lambda p: p["level"] == 0)).alias("p"))
    origin = written_by.select("conv_id", "turn", F.explode(_keys(F.col("p.body"))).alias("k")).groupBy("conv_id", "k").agg(F.min("turn").alias("origin"))

    quotes = parsed.where("quoting and conv_id is not null and turn is not null").select("key", "conv_id", "turn", F.posexplode(F.filter("passages", lambda p: p["level"] > 0)).alias("n", "p"))
    asked = quotes.dropDuplicates(["key", "n"]).select("key", "conv_id", "turn", "n", F.col("p.level").alias("level"), F.explode(_keys(F.col("p.body"))).alias("k"))
    hits = asked.join(origin, ["conv_id", "k"]).where("origin < turn")
    best = F.min(F.struct(F.col("level"), (-F.col("k.chars")).alias("chars"), F.col("origin")))
    links = written(hits.groupBy("key").agg(best.alias("best"), F.count_distinct("n").alias("n_linked"), F.min("conv_id").alias("conv_id"), F.min("turn").alias("turn")), "links")
    roots = _roots(links.groupBy("conv_id", "turn").agg(F.min("best.origin").alias("up")))

    quoted = F.filter("passages", lambda p: p["level"] > 0)
    out = parsed.select("conv_id", "turn", "role", "clean", "key", F.size(quoted).alias("n_quoted"), F.coalesce(F.array_max(F.transform(quoted, lambda p: p["level"])), F.lit(0)).alias("max_level"))
    out = out.dropDuplicates(["key", "role"]).join(links.select("key", F.col("best.origin").alias("reply_to"), "n_linked"), "key", "left").join(roots, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "n_quoted", "max_level", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "reply_to",
        F.coalesce("thread", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"), "clean",
    )


def _roots(replies: DataFrame) -> DataFrame:
    """conv_id, turn, thread and depth of replies (conv_id, turn, up): up is always lower, so chains end."""
    at = written(replies.select("conv_id", "turn", F.col("up").alias("thread"), F.lit(1).alias("depth")), "replies")
    while True:
        above = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("top"), F.col("depth").alias("more"))
        further = at.join(above, ["conv_id", "thread"], "left")
        if not further.where("top is not null").limit(1).count():
            return at
        at = written(further.select("conv_id", "turn", F.coalesce("top", "thread").alias("thread"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "replies")


def conversations(messages: DataFrame) -> DataFrame:
    """Conversations in reply order: conv_id, piece and messages, an array of structs.

    Threads follow one another by their first turn, the messages of a thread by turn; those without a turn come
    first. A conversation is one row, unless its texts weigh more than PIECE bytes: then its rows, numbered by piece
    from 0, each begin where that many bytes more have gone before, and read one after another they are the
    conversation. Messages without a conversation are put together in the same way.
    """
    fields = ["thread", "turn", "role", "reply_to", "depth", "n_quoted", "n_linked", "text"]
    rows = written(linked(messages).withColumnRenamed("clean", "text").select("conv_id", *fields, (F.octet_length("text") + MESSAGE).cast("long").alias("weight")), "messages")
    together = lambda df: df.groupBy("conv_id", "piece").agg(F.array_sort(F.collect_set(F.struct(*fields))).alias("messages"))
    large = written(rows.groupBy("conv_id").agg(F.sum("weight").alias("_bytes")).where(F.col("_bytes") > PIECE).select(F.col("conv_id").alias("_conv"), F.lit(True).alias("_large")), "large")
    if not large.limit(1).count():
        return together(rows.withColumn("piece", F.lit(0).cast("long")))
    told = rows.join(large, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    ordered = written(running(told.where("_large").select("conv_id", *fields, "weight"), ["conv_id", *fields], "weight", "before"), "ordered")
    begins = ordered.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("before").alias("_begin"))
    cut = ordered.join(begins, F.col("conv_id").eqNullSafe(F.col("_conv"))).withColumn("piece", F.floor((F.col("before") - F.col("_begin")) / PIECE).cast("long"))
    whole = told.where("_large is null").withColumn("piece", F.lit(0).cast("long"))
    columns = ["conv_id", *fields, "piece"]
    return together(whole.select(columns).unionByName(cut.select(columns)))


def op8_quotation(messages: DataFrame) -> DataFrame:
    told = conversations(messages.select("conv_id", "turn", "role", "text"))
    total = lambda c: F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + m[c])
    return told.select(
        "conv_id", "piece", F.size("messages").cast("long").alias("n_messages"), total("n_quoted").alias("n_quoted"), total("n_linked").alias("n_linked"),
        F.array_join(F.transform("messages", lambda m: F.concat_ws(">", m["turn"], m["reply_to"])), ",").alias("turns"),
        F.array_join(F.transform("messages", lambda m: F.concat(F.coalesce(m["role"], F.lit("")), F.lit(": "), m["text"])), "\n\n").alias("chat"),
    )


_Q = "^(?:[ \\t]{0,3}>)+"
OP8_SQL = f"""
WITH RECURSIVE m AS (SELECT *, row_number() OVER () AS r FROM (SELECT DISTINCT conv_id, turn, role, coalesce(text, '') AS t FROM conversations)),
l0 AS (SELECT r, unnest(regexp_split_to_array(t, '\\r?\\n')) AS line, unnest(range(1, len(regexp_split_to_array(t, '\\r?\\n')) + 1)) AS i FROM m),
l1 AS (SELECT r, i, length(regexp_replace(regexp_extract(line, '{_Q}'), '[^>]', '', 'g')) AS lv, regexp_replace(line, '{_Q}[ \\t]?', '') AS body FROM l0),
l2 AS (SELECT *, lv = 0 AND NOT (regexp_matches(body, '{ANNOUNCE}') AND coalesce(lead(lv) OVER (PARTITION BY r ORDER BY i), 0) > 0) AS kept, max(lv) OVER (PARTITION BY r) > 0 AS q FROM l1),
l3 AS (SELECT *, trim(body, ' ') = '' OR (lv = 0 AND NOT kept) AS blank FROM l2),
l4 AS (SELECT *, CASE WHEN blank OR coalesce(lag(blank) OVER w, true) OR lag(lv) OVER w <> lv THEN 1 ELSE 0 END AS new FROM l3 WINDOW w AS (PARTITION BY r ORDER BY i)),
l5 AS (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM l4),
p AS (SELECT r, g, any_value(lv) AS lv, string_agg(body, chr(10) ORDER BY i) AS body FROM l5 WHERE NOT blank GROUP BY r, g),
x AS (SELECT r, g, lv, body AS s, 0 AS least FROM p UNION ALL SELECT r, g, lv, unnest(string_split(body, chr(10))), {LINE_CHARS} FROM p),
k AS (SELECT DISTINCT r, g, lv, trim(regexp_replace(lower(s), '\\s+', ' ', 'g')) AS s FROM x WHERE length(trim(regexp_replace(lower(s), '\\s+', ' ', 'g'))) >= greatest(least, 1)),
o AS (SELECT conv_id, s, min(turn) AS origin FROM k JOIN m USING (r) WHERE lv = 0 GROUP BY ALL),
h AS (SELECT r, g, lv, s, origin FROM k JOIN m USING (r) JOIN o USING (conv_id, s) WHERE lv > 0 AND origin < turn),
b AS (SELECT r, count(DISTINCT g) AS n_linked, arg_min(origin, (lv, -length(s), origin)) AS reply_to FROM h GROUP BY r),
e AS (SELECT conv_id, turn, min(reply_to) AS up FROM b JOIN m USING (r) GROUP BY ALL),
t AS (SELECT conv_id, turn, up AS thread FROM e UNION ALL SELECT t.conv_id, t.turn, e.up FROM t JOIN e ON e.conv_id = t.conv_id AND e.turn = t.thread),
th AS (SELECT conv_id, turn, min(thread) AS thread FROM t GROUP BY ALL),
c AS (SELECT r, regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (kept), ''), '^(?:[ \\t]*\\n)+|(?:\\n[ \\t]*)+$', '', 'g') AS clean FROM l2 WHERE q GROUP BY r),
n AS (SELECT r, count(*) FILTER (lv > 0) AS n_quoted FROM p GROUP BY r),
a AS (SELECT m.conv_id, m.turn, m.role, coalesce(c.clean, t) AS text, coalesce(th.thread, m.turn) AS thread, reply_to, coalesce(n_quoted, 0) AS n_quoted, coalesce(n_linked, 0) AS n_linked
  FROM m LEFT JOIN c USING (r) LEFT JOIN n USING (r) LEFT JOIN b USING (r) LEFT JOIN th ON th.conv_id = m.conv_id AND th.turn = m.turn),
z AS (SELECT *, floor(coalesce(sum(strlen(text) + {MESSAGE}) OVER (PARTITION BY conv_id ORDER BY thread NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {PIECE})::BIGINT AS piece FROM a)
SELECT conv_id, piece, count(*) AS n_messages, sum(n_quoted)::BIGINT AS n_quoted, sum(n_linked)::BIGINT AS n_linked,
  string_agg(concat_ws('>', turn, reply_to), ',' ORDER BY thread NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text) AS turns, string_agg(coalesce(role, '') || ': ' || text, chr(10) || chr(10) ORDER BY thread NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text) AS chat
FROM z GROUP BY ALL
"""
