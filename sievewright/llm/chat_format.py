"""Chat conversations as one training text each, with a loss mask, and back (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around the turns of known roles: before the first text of a run, between its texts, after its last.
MARKS = {"system": ("[SYS]", "[+SYS]", "[/SYS]"), "user": ("[INST]", "[+INST]", "[/INST]"), "assistant": ("[ANS]", "[+ANS]", "</s>")}
#: Other roles stand in the text: ``[ROLE]name[AS]text[+ROLE]name[AS]text[/ROLE]``.
OTHER, AS, BEGIN = ("[ROLE]", "[+ROLE]", "[/ROLE]"), "[AS]", "<s>"
#: The role whose texts are learned.
LEARNED = "assistant"
#: A control string as texts may hold it: with any number of backslashes behind its bracket. As a mark it has none.
_NAMES, _ENDS = r"[+/]?(?:SYS|INST|ANS|ROLE|AS)\]", r"/?s>"
MARK = rf"\[{_NAMES}|<{_ENDS}"
_TO_ESCAPE = rf"\[(?=\\*{_NAMES})|<(?=\\*{_ENDS})"
_ESCAPED = rf"(?<=\[)\\(?=\\*{_NAMES})|(?<=<)\\(?=\\*{_ENDS})"
#: Lengths are summed, and spans cut, in blocks of so many, so that the work stays near linear in a conversation's turns.
BLOCK = 128


def escape(text: Column) -> Column:
    """``text`` with one backslash more in each control string, so that none is a mark."""
    return F.regexp_replace(text, _TO_ESCAPE, r"$0\\")


def unescape(text: Column) -> Column:
    """The text that :func:`escape` was given."""
    return F.regexp_replace(text, _ESCAPED, "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: an expression that a lambda repeats would be worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(values: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda k: F.slice(values, k * size + 1, F.lit(size)))


def _starts(lengths: Column) -> Column:
    """Where each piece starts (from 0): running sums of the pieces' lengths, within blocks and over blocks."""
    zero = F.array(F.lit(0).cast("long"))
    running = lambda values: F.aggregate(values, zero, lambda had, n: F.concat(had, F.array(F.element_at(had, -1) + n)))

    def placed(blocks: Column) -> Column:
        totals = running(F.transform(blocks, lambda b: F.element_at(b, -1)))
        within = lambda before: F.transform(blocks, lambda b, k: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda n: n + F.get(before, k)))
        return F.flatten(_let(totals, within))

    return _let(_let(lengths, lambda n: F.transform(_blocks(n, BLOCK), running)), placed)


def runs(turns: Column) -> Column:
    """Sorted turns -> runs of one role: ``role, texts``. A run goes from where the role changes to where it changes next."""
    first = F.filter(F.sequence(F.lit(1), F.size(turns)), lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]))

    def merged(change: Column) -> Column:
        until = lambda k: F.coalesce(F.get(change, k + 1), F.size(turns) + 1)
        texts = lambda start, k: F.transform(F.slice(turns, start, until(k) - start), lambda t: t["text"])
        return F.transform(change, lambda start, k: F.struct(F.get(turns, start - 1)["role"].alias("role"), texts(start, k).alias("texts")))

    return _let(first, merged)


def _pieces(run: Column) -> Column:
    """A run as ``piece, learned`` structs: marks and texts in turn; each piece starts where the one before ends."""

    def by_role(k: int) -> Column:
        known = F.lit(None).cast("string")
        for role, marks in MARKS.items():
            known = F.when(run["role"] == role, marks[k]).otherwise(known)
        other = F.lit(OTHER[k]) if k == 2 else F.concat(F.lit(OTHER[k]), escape(run["role"]), F.lit(AS))
        return F.coalesce(known, other)

    piece = lambda text, learned: F.struct(text.alias("piece"), learned.alias("learned"))
    texts = F.flatten(F.transform(run["texts"], lambda text, i: F.array(piece(F.when(i == 0, by_role(0)).otherwise(by_role(1)), F.lit(False)), piece(escape(text), run["role"] == LEARNED))))
    return F.concat(texts, F.array(piece(by_role(2), F.lit(False))))


def format_conversations(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text, ...)`` -> ``conv_id, formatted, loss``, one row per conversation.

    Turns are collected and sorted by ``turn``, adjacent turns of one role merged into one run, and runs written as
    ``[INST]text[+INST]text[/INST]`` (likewise ``SYS``; an answer ends with ``</s>``; other roles are named in the text). Control strings inside texts and
    roles get a backslash behind their bracket. ``loss`` holds ``start, stop`` code points (from 0, end exclusive) of every assistant text in ``formatted``, marks left out.

    Defined cases: null text or role is empty; turns of one number go by role, then text, null numbers first; repeated rows are turns of their own;
    rows without ``conv_id`` are one conversation; an empty table gives no rows; very long texts stay whole; extra columns, whatever their names, are ignored.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    merged = sorted_turns.select("conv_id", runs(F.col("turns")).alias("runs"))
    begin = F.array(F.struct(F.lit(BEGIN).alias("piece"), F.lit(False).alias("learned")))
    cut = merged.select("conv_id", F.concat(begin, F.flatten(F.transform("runs", _pieces))).alias("pieces"))
    placed = cut.withColumn("starts", _starts(F.transform("pieces", lambda p: F.char_length(p["piece"]).cast("long"))))
    spans = F.transform(F.arrays_zip("pieces", "starts"), lambda x: F.struct(F.when(x["pieces"]["learned"], x["starts"]).alias("start"), (x["starts"] + F.char_length(x["pieces"]["piece"])).alias("stop")))
    return placed.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), F.filter(spans, lambda s: s["start"].isNotNull()).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted text holds: ``role, text`` structs, unescaped, in order."""
    marks = F.regexp_extract_all(formatted, F.lit(f"({MARK})"), F.lit(1))

    def turns(texts: Column) -> Column:  # texts[i + 1] follows marks[i]
        def turn(mark: Column, i: Column) -> Column:
            known = F.lit(None).cast("string")
            for name, (first, more, _) in MARKS.items():
                known = F.when(mark.isin(first, more), name).otherwise(known)
            named = F.when(mark == AS, unescape(F.get(texts, i)))
            return F.struct(F.coalesce(known, named).alias("role"), unescape(F.get(texts, i + 1)).alias("text"))

        return F.filter(F.transform(marks, turn), lambda t: t["role"].isNotNull())

    return _let(F.split(formatted, MARK), turns)


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between; cut span by span out of the stretches of :data:`BLOCK` spans."""

    def stretch(spans: Column) -> Column:
        start = F.get(spans, F.lit(0))["start"]
        cut = lambda text, s: F.substring(text, (s["start"] - start + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))
        own = F.substring(formatted, (start + 1).cast("int"), (F.element_at(spans, -1)["stop"] - start).cast("int"))
        return _let(own, lambda text: F.array_join(F.transform(spans, lambda s: unescape(cut(text, s))), ""))

    return F.when(F.size(loss) == 0, "").otherwise(F.array_join(F.transform(_blocks(loss, BLOCK), stretch), ""))


def digests(formatted: DataFrame) -> DataFrame:
    """What the outputs of :func:`format_conversations` say when they are read back."""
    read = formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, len(text) + len(regexp_extract_all(text, '\[\\*[+/]?(?:SYS|INST|ANS|ROLE|AS)\]|<\\*/?s>')) AS chars,
    len(role) + len(regexp_extract_all(role, '\[\\*[+/]?(?:SYS|INST|ANS|ROLE|AS)\]|<\\*/?s>')) AS named,
    coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) <> role, true) AS opens FROM t),
s AS (
  SELECT *, chars + CASE role WHEN 'system' THEN CASE WHEN opens THEN 11 ELSE 6 END WHEN 'user' THEN CASE WHEN opens THEN 13 ELSE 7 END
      WHEN 'assistant' THEN CASE WHEN opens THEN 9 ELSE 6 END ELSE named + CASE WHEN opens THEN 17 ELSE 11 END END AS n FROM m)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n))::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
