r"""Chat formatting proven by a grammar round trip.

A conversation becomes one text in which marks open and close every turn:

    conversation := turn*
    turn         := [SYS] body [/SYS] | [INST] body [/INST] | <s> body </s>
                  | [ROLE] body [/ROLE] [TEXT] body [/TEXT]

for the system, the user, the assistant, and any other role by name. No mark may stand inside
a body. The rendered text is parsed again: the marks and what lies between them are two regular
expression passes, and the marks must alternate as the grammar says. A turn whose parse is not
the turn itself is escaped and parsed again, until it is identical; the assembled conversation
is compared once more as a whole. DataFrame functions only.

Escaping puts one backslash after the first character of everything that looks like a mark,
however many backslashes it already has there (``[INST]`` and ``[\INST]`` become ``[\INST]`` and
``[\\INST]``); unescaping takes one away. Other text stays as it is.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Opening mark by role; a closing mark has a slash after the first character.
OPENING = {"system": "[SYS]", "user": "[INST]", "assistant": "<s>"}
NAME, BODY = "[ROLE]", "[TEXT]"
LOSS_ROLE = "assistant"

REST = r"(?:/?(?:SYS|INST|ROLE|TEXT)\]|/?s>)"
MARK = r"\[/?(?:SYS|INST|ROLE|TEXT)\]|</?s>"
#: Renderings tried for a turn: as it is, then with one level of escapes, which always suffices.
ROUNDS = 2


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])(\\*{REST})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([\[<])\\(\\*{REST})", "$1$2")


def closing(mark: Column) -> Column:
    return F.concat(F.substring(mark, 1, 1), F.lit("/"), mark.substr(F.lit(2), F.length(mark)))


def between(opening: Column, body: Column) -> Column:
    return F.concat(opening, body, closing(opening))


def opening_of(role: Column) -> Column:
    """The mark that opens a turn's body."""
    out = F.lit(BODY)
    for name, mark in OPENING.items():
        out = F.when(role == name, mark).otherwise(out)
    return out


def rendered(role: Column, text: Column, level: int) -> Column:
    """One turn under the grammar, its texts escaped ``level`` times."""
    for _ in range(level):
        role, text = escape(role), escape(text)
    name = F.when(role.isin(*OPENING), "").otherwise(between(F.lit(NAME), role))
    return F.concat(name, between(opening_of(role), text))


def parse(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Adds ``out_col`` array<struct<role, text>>: the turns of a formatted text, NULL if it breaks the grammar.

    NULL texts have no parse; the empty text has no turns. Columns named ``_marks``, ``_parts``,
    ``_units`` and ``_pairs`` are used on the way.
    """
    cut = df.withColumns({"_marks": F.regexp_extract_all(text_col, F.lit(MARK), F.lit(0)), "_parts": F.split(text_col, MARK, -1)})
    # each mark with what follows it: opening marks with bodies, closing marks with gaps
    cut = cut.withColumn("_units", F.zip_with("_marks", F.slice("_parts", F.lit(2), F.size("_marks")), lambda m, p: F.struct(m.alias("mark"), p.alias("body"))))
    opens, closes = F.filter("_units", lambda u, j: j % 2 == 0), F.filter("_units", lambda u, j: j % 2 == 1)
    nothing = F.array().cast("array<struct<mark:string,body:string>>")
    cut = cut.withColumn("_pairs", F.when(
        (F.transform(opens, lambda u: closing(u["mark"])) == F.transform(closes, lambda u: u["mark"]))
        & F.forall(closes, lambda u: u["body"] == "") & (F.get("_parts", F.lit(0)) == ""),
        F.coalesce(opens, nothing),
    ))
    before = F.concat(F.array(F.struct(F.lit("").alias("mark"), F.lit("").alias("body"))), F.slice("_pairs", F.lit(1), F.greatest(F.size("_pairs") - 1, F.lit(0))))
    steps = F.zip_with("_pairs", F.when(F.size("_pairs") > 0, before).otherwise(nothing), lambda p, q: F.struct(
        p["mark"].alias("mark"), p["body"].alias("body"), q["mark"].alias("led_by"), q["body"].alias("name"),
    ))
    named = (F.get("_pairs", F.size("_pairs") - 1)["mark"] != NAME) | (F.size("_pairs") == 0)
    fits = F.forall(steps, lambda s: (s["mark"] == BODY) == (s["led_by"] == NAME))
    role = lambda s: F.coalesce(*[F.when(s["mark"] == mark, name) for name, mark in OPENING.items()], unescape(s["name"]))
    turns = F.transform(F.filter(steps, lambda s: s["mark"] != NAME), lambda s: F.struct(role(s).alias("role"), unescape(s["body"]).alias("text")))
    return cut.withColumn(out_col, F.when(named & fits, turns)).drop("_marks", "_parts", "_units", "_pairs")


def same_turns(back: Column, role: Column, text: Column) -> Column:
    return back.eqNullSafe(F.array(F.struct(role.alias("role"), text.alias("text"))))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, ``formatted`` text and ``loss`` array<struct<start, end>>.

    ``loss`` is the loss mask: code points of ``formatted``, end exclusive, that hold the
    assistant's texts (escaped as they stand there), in order; empty texts have empty spans. Rows
    are taken by turn, then role, then text, so repeated turns all stay, in a fixed order; NULL
    turns come first. NULL roles and texts count as empty, NULL ids are one conversation, other
    columns are not read, and an empty table gives an empty result. A conversation that does not
    come back from its text as it went in is an error.

    Turns are rendered, parsed and escaped on their own rows. One shuffle by conversation; offsets
    are running sums over it. A conversation is one text and so one row: what must fit in a task
    is the longest conversation.
    """
    said = rows.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    said = parse(said.withColumn("piece", rendered(F.col("role"), F.col("text"), 0)), "piece", "back")
    for level in range(1, ROUNDS):
        same = same_turns(F.col("back"), F.col("role"), F.col("text"))
        said = parse(said.withColumn("piece", F.when(same, F.col("piece")).otherwise(rendered(F.col("role"), F.col("text"), level))), "piece", "back")
    said = said.withColumn("piece", F.when(same_turns(F.col("back"), F.col("role"), F.col("text")), F.col("piece")).otherwise(F.raise_error(F.lit("a turn has no rendering that parses back to it"))))
    so_far = Window.partitionBy("id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = OPENING[LOSS_ROLE]
    placed = said.withColumn("end", F.sum(F.length("piece").cast("long")).over(so_far) - len(mark) - 1)
    placed = placed.withColumn("start", F.when(F.col("role") == LOSS_ROLE, F.col("end") - F.length("piece") + 2 * len(mark) + 1))
    talks = placed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "start", "end", "piece"))).alias("said"))
    talks = talks.withColumns({
        "formatted": F.array_join(F.transform("said", lambda t: t["piece"]), ""),
        "loss": F.transform(F.filter("said", lambda t: t["start"].isNotNull()), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))),
    })
    source = F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    whole = parse(talks, "formatted", "back").withColumn("formatted", F.when(F.col("back").eqNullSafe(source), F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not parse back to its turns"))))
    return whole.select(F.col("id").alias(id_col), "formatted", "loss")


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescape(formatted.substr(s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")))), "")
