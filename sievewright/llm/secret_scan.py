"""Secrets in texts: patterns, and sliding-window entropy over candidate strings (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the base kinds, in the order in which spans of equal start are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
#: Candidate strings of the entropy scan, its window, and the least entropy of a window in bits by the class of its characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
LEAST_HEX, LEAST_UPPER, LEAST_MIXED = 3.0, 3.4, 3.75
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Strings that are no secrets: UUIDs (blanked before the scan), and spans without a letter beside a digit (numbers, paths and
#: words joined by marks), documentation samples and runs.
UUID = r"(?<![0-9A-Za-z-])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9A-Za-z-])"
MIXED = r"[A-Za-z][0-9]|[0-9][A-Za-z]"
SAMPLES = r"(?i)example|lorem|0123456789|abcdefghij|x{8}|(.)\1{7}"
#: Code points of a block of a text, and values of a chunk of a running fold: what is copied or walked at once.
BLOCK, CHUNK = 4096, 256
#: Bits are counted in whole billionths, so that what comes and goes leaves nothing behind.
_UNIT = 1_000_000_000
_TERMS = [round(n * math.log2(n) * _UNIT) if n else 0 for n in range(WINDOW + 2)]
_NOTHING = "cast(array() as array<struct<lo:int,hi:int>>)"


def _before(values: str, fold: str) -> str:
    """For each of an array's integers the fold (``+`` or ``greatest``) of those before it, in linear time.

    An array grows by copying it, so it is built in chunks, each from the fold of the chunks before.
    """
    step = (lambda a, b: f"{a} + {b}") if fold == "+" else (lambda a, b: f"greatest({a}, {b})")
    chunks = f"if(size({values}) = 0, cast(array() as array<int>), sequence(0, cast((size({values}) - 1) div {CHUNK} as int)))"
    folded = f"transform({chunks}, k -> aggregate(slice({values}, k * {CHUNK} + 1, {CHUNK}), 0, (a, x) -> {step('a', 'x')}))"
    bases = f"aggregate({folded}, named_struct('run', 0, 'out', cast(array() as array<int>)), (a, x) -> named_struct('run', {step('a.run', 'x')}, 'out', array_append(a.out, a.run)), a -> a.out)"
    inner = f"aggregate(slice({values}, k * {CHUNK} + 1, {CHUNK}), named_struct('run', base, 'out', cast(array() as array<int>)), (a, x) -> named_struct('run', {step('a.run', 'x')}, 'out', array_append(a.out, a.run)), a -> a.out)"
    return f"flatten(transform({bases}, (base, k) -> {inner}))"


def _cut(blocks: str, a: str, b: str) -> str:
    """Code points ``a`` to ``b`` of a text that lies in blocks: no more than their blocks are walked."""
    first, last = f"cast(({a}) div {BLOCK} as int)", f"cast(({b}) div {BLOCK} as int)"
    return f"""if({b} <= {a}, '', if({first} = {last}, substr(get({blocks}, {first}), ({a}) % {BLOCK} + 1, ({b}) - ({a})), concat(
        substr(get({blocks}, {first}), ({a}) % {BLOCK} + 1), array_join(slice({blocks}, {first} + 2, {last} - {first} - 1), ''),
        coalesce(substr(get({blocks}, {last}), 1, ({b}) % {BLOCK}), ''))))"""


def _blocks(text: str) -> str:
    return f"regexp_extract_all({text}, '(?s).{{1,{BLOCK}}}', 0)"


def _replaced(blocks: str, spans: str, done: str, mark: str, length: str) -> str:
    """A text with its spans (by start) replaced; ``done`` holds for each span how far the spans before it reach."""
    kept = f"transform({spans}, (x, i) -> if(x.at < {done}[i], '', concat({_cut(blocks, f'{done}[i]', 'x.at')}, {mark})))"
    end = f"array_max(transform({spans}, x -> x.until))"
    return f"concat(array_join({kept}, ''), {_cut(blocks, end, length)})"


def _hot_windows(item: str) -> str:
    """Spans of a block's windows whose entropy reaches the least of their class; windows that overlap or touch are one span.

    ``counts`` holds a letter for each symbol, as far from ``A`` as the symbol occurs in the window; each step changes those of
    the symbol that comes and of the one that leaves. The numbers of symbols that are no hex digits, that are
    neither capitals nor digits, of digits and of marks or blanks follow in the same way.
    """
    terms = f"array({', '.join(f'{t}L' for t in _TERMS)})"
    codes = f"transform(split({item}, ''), c -> instr('{ALPHABET}', c))"
    is_digit = lambda c: f"{c} between 53 and 62"
    is_hex = lambda c: f"({c} between 1 and 6 or {c} between 27 and 32 or {is_digit(c)})"
    is_upper = lambda c: f"({c} between 1 and 26 or {is_digit(c)})"
    tally = lambda test: f"if(m.came > 0 and {test('m.came')}, 1, 0) - if(m.left > 0 and {test('m.left')}, 1, 0)"
    no_hex, no_upper, digit = tally(lambda c: f"not {is_hex(c)}"), tally(lambda c: f"not {is_upper(c)}"), tally(is_digit)
    ascii_at = lambda s, k: f"ascii(substr({s}, {k}, 1))"
    put = lambda s, k, n: f"overlay({s} placing char({n}) from {k} for 1)"
    step = f"""transform(transform(transform(array(named_struct('came', t.codes[a.i], 'left', if(a.i >= {WINDOW}, t.codes[a.i - {WINDOW}], 0))),
        m -> named_struct('came', m.came, 'left', m.left, 'n', if(m.came > 0, {ascii_at('a.counts', 'm.came')}, 65), 'counts', a.counts)),
        m -> named_struct('came', m.came, 'left', m.left, 'n', m.n, 'counts', if(m.came > 0, {put('m.counts', 'm.came', 'm.n + 1')}, m.counts))),
        m -> transform(array(if(m.left > 0, {ascii_at('m.counts', 'm.left')}, 65)), gone -> named_struct(
            'counts', if(m.left > 0, {put('m.counts', 'm.left', 'gone - 1')}, m.counts),
            'sum', a.sum + if(m.came > 0, t.terms[m.n - 64] - t.terms[m.n - 65], 0L) + if(m.left > 0, t.terms[gone - 66] - t.terms[gone - 65], 0L),
            'whole', if(m.came > 0, a.whole + 1, 0), 'nohex', a.nohex + {no_hex}, 'noupper', a.noupper + {no_upper}, 'digits', a.digits + {digit}))[0])[0]"""
    least = f"case when b.nohex = 0 then {LEAST_HEX}D when b.noupper = 0 then {LEAST_UPPER}D else {LEAST_MIXED}D end"
    most = f"cast(floor((log2({WINDOW}D) - {least}) * {WINDOW * _UNIT}D) as bigint)"
    hot = f"b.whole >= {WINDOW} and b.digits > 0 and b.digits < {WINDOW} and b.sum <= {most}"
    spans = f"""case when not ({hot}) then a.out
        when size(a.out) > 0 and element_at(a.out, -1).hi >= a.i - {WINDOW - 1}
            then array_append(slice(a.out, 1, size(a.out) - 1), named_struct('lo', element_at(a.out, -1).lo, 'hi', a.i + 1))
        else array_append(a.out, named_struct('lo', a.i - {WINDOW - 1}, 'hi', a.i + 1)) end"""
    judged = f"""transform(array({step}), b -> named_struct('i', a.i + 1, 'counts', b.counts, 'sum', b.sum, 'whole', b.whole,
        'nohex', b.nohex, 'noupper', b.noupper, 'digits', b.digits, 'out', {spans}))[0]"""
    start = f"named_struct('i', 0, 'counts', repeat('A', {len(ALPHABET)}), 'sum', 0L, 'whole', 0, 'nohex', 0, 'noupper', 0, 'digits', 0, 'out', {_NOTHING})"
    # the codes and the terms are bound once, by a lambda over an array of one
    return f"""transform(array(named_struct('codes', {codes}, 'terms', {terms})), t -> aggregate(t.codes, {start}, (a, c) -> {judged}, a -> a.out))[0]"""


def _matches(out: DataFrame, name: str, text: str, pattern: str) -> DataFrame:
    """Adds ``_name``: the matches of a pattern as code point spans with what they hold."""
    out = out.withColumn("_parts", F.split(text, pattern, -1))
    out = out.withColumn("_found", F.when(F.size("_parts") > 1, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("_both", F.expr("transform(_found, (x, i) -> length(_parts[i]) + length(x))"))
    out = out.withColumn("_start", F.when(F.size("_found") > 0, F.expr(_before("_both", "+"))).otherwise(F.array().cast("array<int>")))
    spans = F.expr("transform(_found, (x, i) -> named_struct('at', _start[i] + length(_parts[i]), 'until', _start[i] + _both[i], 'item', x))")
    return out.withColumn(f"_{name}", spans).drop("_parts", "_found", "_both", "_start")


def _scan(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of ``docs``), ``text`` (null as empty) and ``secrets``; names of ``docs`` cannot clash."""
    out = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX)):
        out = _matches(out, name, "text", pattern)
    long_enough = lambda x: F.length(F.regexp_extract(x["item"], ASSIGN, 2)) >= 6
    out = out.withColumn("_assign", F.filter("_assign", long_enough))
    kind = lambda name, rank: f"transform(_{name}, x -> named_struct('at', x.at, 'rank', {rank}, 'until', x.until, 'kind', '{name}'))"
    out = out.withColumn("_base", F.expr(f"array_sort(concat({kind('assign', 0)}, {kind('access', 1)}, {kind('hex', 2)}))"))
    # what the base patterns have is blanked, and the rest is searched for windows
    out = out.withColumn("_until", F.expr("transform(_base, x -> x.until)")).withColumn("_done", F.expr(_before("_until", "max")))
    blank = _replaced("blocks", "_base", "_done", "repeat(' ', x.until - x.at)", "length(text)")
    out = out.withColumn("_rest", F.when(F.size("_base") > 0, F.expr(f"transform(array({_blocks('text')}), blocks -> {blank})[0]")).otherwise(F.col("text")))
    out = _matches(out, "entropy", "_rest", CANDIDATE)
    quoted = UUID.replace("\\", "\\\\")
    clean = f"if(length(x.item) < 36, x.item, regexp_replace(x.item, '{quoted}', repeat(' ', 36)))"
    # candidates in blocks that overlap by a window less one, each with its place in the text
    pieces = f"""flatten(transform(_entropy, x -> transform(array({_blocks(clean)}), blocks -> transform(blocks, (p, k) -> named_struct(
        'at', x.at + k * {BLOCK}, 'item', concat(p, coalesce(substr(get(blocks, k + 1), 1, {WINDOW - 1}), '')))))[0]))"""
    # no window is hot without letter and digit
    pieces = f"filter({pieces}, x -> x.item rlike '{MIXED}')"
    found = f"flatten(transform({pieces}, x -> transform({_hot_windows('x.item')}, y -> named_struct('at', x.at + y.lo, 'until', x.at + y.hi))))"
    nothing = F.array().cast("array<struct<at:int,until:int>>")
    out = out.withColumn("_hot", F.when(F.size("_entropy") > 0, F.expr(found)).otherwise(nothing))
    # spans of neighbouring blocks that touch are one
    first = "transform(filter(transform(_hot, (x, i) -> named_struct('x', x, 'new', i = 0 or x.at > _hot[i - 1].until)), z -> z.new), z -> z.x.at)"
    last = "transform(filter(transform(_hot, (x, i) -> named_struct('x', x, 'end', i = size(_hot) - 1 or get(_hot, i + 1).at > x.until)), z -> z.end), z -> z.x.until)"
    out = out.withColumn("_hot", F.when(F.size("_hot") > 0, F.expr(f"zip_with({first}, {last}, (a, b) -> named_struct('at', a, 'until', b))")).otherwise(nothing))
    samples = SAMPLES.replace("\\", "\\\\")
    held = _cut("blocks", "x.at", "x.until")
    fresh = f"""transform(array({_blocks('_rest')}), blocks -> filter(_hot, x -> exists(array({held}), y -> y rlike '{MIXED}' and not y rlike '{samples}')))[0]"""
    out = out.withColumn("_hot", F.when(F.size("_hot") > 0, F.expr(fresh)).otherwise(nothing))
    added = "transform(_hot, x -> named_struct('at', x.at, 'rank', 3, 'until', x.until, 'kind', 'entropy'))"
    spans = F.expr(f"transform(if(size(_hot) = 0, _base, array_sort(concat(_base, {added}))), x -> named_struct('at', x.at, 'until', x.until, 'kind', x.kind))")
    return out.select("row", "text", spans.alias("secrets"))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``secrets``: ``array<struct<at, until, kind>>``, code points, end exclusive, by start and kind.

    Kinds: ``assign`` (a named credential and a value of six characters or more), ``access`` and ``hex``
    (long runs), and ``entropy``: windows of 20 characters with a letter and a digit whose Shannon entropy reaches
    the least of the window's character class (hex digits; capitals and digits; all others), as far as no
    base span has them; such windows that overlap or touch are one span, which the allow-list may suppress.
    A base pattern's matches are found leftmost and without overlap on the whole text; those that are too
    short are dropped after they have consumed what they matched. Time is linear in a text's length, number
    of matches and length of candidates.

    Defined cases: null and empty texts have no spans; a column ``secrets`` of ``docs`` is replaced, all others pass unchanged;
    repeated rows are scanned each.
    """
    return _scan(docs).select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "secrets"], "secrets")


def joined(spans: str) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.expr(f"array_join(transform({spans}, x -> concat(x.kind, ':', x.at, ':', x.until)), ',')")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret span replaced by ``mark`` (overlapping spans by one) and ``n_chars`` set anew; other texts stay as they are."""
    quoted = mark.replace("\\", "\\\\").replace("'", "\\'")
    piece = f"transform(array({_blocks('text')}), blocks -> {_replaced('blocks', 'secrets', '_done', f"'{quoted}'", 'length(text)')})[0]"
    some = F.size("secrets") > 0
    found = _scan(docs).withColumn("_until", F.expr("transform(secrets, x -> x.until)")).withColumn("_done", F.expr(_before("_until", "max"))).withColumn("clean", F.when(some, F.expr(piece)).otherwise(F.col("row.text")))
    new = {"text": F.col("clean"), "n_chars": F.when(some, F.length("clean").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
