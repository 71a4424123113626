"""Secret scans with DataFrame functions only: patterns, and character Markov models.

The patterns mark assignments, access keys and hex runs. The models add runs of
identifier characters that look random: two first-order Markov models over characters,
one of random strings and one of ordinary identifiers, are trained from labelled
samples (spans that the patterns mark, and runs that they don't) of at most
``SAMPLE_ROWS`` texts, and a run is added when the log-likelihood ratio of its
characters exceeds ``LEAST_RATIO``. The models are one table of at most 66 x 66 numbers.

Each kind is searched for once, and only where a cheaper search shows that there may be
a match that is long enough; where it is found, the text is cut at its matches, and
running sums over what lies between and the matches give places in code points and in
bytes. All of it stays in the JVM, in one pass without a shuffle. Sums over n matches
run in blocks of the root of n, overlaps are found by ranks in sorted lists, and masking
cuts bytes, so long runs, and texts of very many matches, cost little more than their length.

Defined results: null text counts as empty; repeated rows and null ids are scanned
like others; an empty table gives an empty result; :func:`mask_secrets` keeps all other
columns untouched, whatever their names, and a null text null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import free

#: Kinds in the order they are listed, their patterns, and the group and least length that a match needs.
KINDS = {
    "assign": (r"""(?=[pPsStTaA])((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"AKIA[A-Z0-9]+", 0, 16),
    "hex": (r"[0-9a-f]{32,}", 0, 32),
}
#: Runs that the models judge: with a letter and a digit, and of 20 characters or more, as shorter ones hold too few pairs to tell
#: a random string from an identifier by LEAST_RATIO without marking identifiers.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: What a text must hold for a match of a kind, or a run, that is long enough; found in much less time.
_GATES = {"assign": r"""[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""", "other": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16}"}
LEAST_RATIO = 8.0
#: Texts that the models learn from, at most; what they learn is labelled by the patterns.
SAMPLE_ROWS = 20_000
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_WIDE = len(LETTERS) + 1
_SPAN = "struct<start:int, kind_at:int, kind:string, end:int, value:string, first_byte:int, end_byte:int>"
_NONE = f"CAST(array() AS array<{_SPAN}>)"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` in which ``name`` is ``value``, worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _sums(sizes: str) -> str:
    """SQL for the running sums of an array of at least one number: within blocks, then over blocks."""
    within = "aggregate(slice(z, i + 1, step), CAST(array() AS array<int>), (s, x) -> concat(s, array(x + IF(size(s) = 0, 0, element_at(s, -1)))))"
    before = "aggregate(blocks, array(0), (s, b) -> concat(s, array(element_at(s, -1) + element_at(b, -1))))"
    added = f"flatten(zip_with(blocks, slice({before}, 1, size(blocks)), (b, o) -> transform(b, x -> x + o)))"
    return _let("z", sizes, _let("step", "CAST(ceil(sqrt(size(z))) AS INT)", _let("blocks", f"transform(sequence(0, size(z) - 1, step), i -> {within})", added)))


def _find(rows: DataFrame, text: str, kinds: dict[str, str]) -> DataFrame:
    """``rows`` with a column of matches for each of ``kinds`` (column name: pattern), empty where a gate shows that none is long enough."""
    gates = free(rows, "assign_gate_", "other_gate_")
    rows = rows.withColumns({g: F.expr(f"`{text}` RLIKE {_quoted(p)}") for g, p in zip(gates, _GATES.values())})
    gate_of = lambda p: gates[0] if p == KINDS["assign"][0] else gates[1]
    return rows.withColumns({name: F.expr(f"IF(`{gate_of(p)}`, regexp_extract_all(`{text}`, {_quoted(p)}, 0), CAST(array() AS array<string>))") for name, p in kinds.items()}).drop(*gates)


def _spans(text: str, found: str, kind: str, at: int, pattern: str, group: int, least: int) -> str:
    """SQL for the spans of one kind's matches ``found`` in a text, in order; the value is the group that must be long enough."""
    p = _quoted(pattern)
    value = f"regexp_extract(m, {p}, {group})" if group else "m"
    stops = lambda size: _sums(f"zip_with(slice(gaps, 1, size({found})), {found}, (g, m) -> {size}(g) + {size}(m))")
    placed = f"""zip_with({found}, zip_with(stops, bytes, (c, b) -> named_struct('c', c, 'b', b)), (m, e) -> named_struct(
        'start', e.c - char_length(m), 'kind_at', {at}, 'kind', '{kind}', 'end', e.c, 'value', {value}, 'first_byte', e.b - octet_length(m), 'end_byte', e.b))"""
    kept = f"filter({placed}, s -> char_length(s.value) >= {least})"
    return f"CASE WHEN size({found}) = 0 THEN {_NONE} ELSE {_let('gaps', f'split({text}, {p}, -1)', _let('stops', stops('char_length'), _let('bytes', stops('octet_length'), kept)))} END"


def _ranks(events: str) -> str:
    """SQL for the places, from 0 on, of those events that open something."""
    return f"filter(transform({events}, (e, i) -> IF(e.opens = 1, i, NULL)), i -> i IS NOT NULL)"


def _events(opening: str, closing: str) -> str:
    """SQL for two arrays of places as one, sorted; at the same place what closes comes first."""
    return f"sort_array(concat(transform({opening}, p -> named_struct('at', p, 'opens', 1)), transform({closing}, p -> named_struct('at', p, 'opens', 0))))"


def _apart(runs: str, base: str) -> Column:
    """The runs that overlap no base span: as many of these start before a run's end as end before its start."""
    ended = f"transform({_ranks(_events(f'{runs}.start', f'{base}.end'))}, (i, k) -> i - k)"
    # a base span that starts where a run ends does not overlap it, so here starts open and run ends close
    begun = f"filter(transform({_events(f'{base}.start', f'{runs}.end')}, (e, i) -> IF(e.opens = 0, i, NULL)), i -> i IS NOT NULL)"
    begun = f"transform({begun}, (i, k) -> i - k)"
    clear = f"filter(zip_with({runs}, zip_with({begun}, {ended}, (x, y) -> x = y), (r, ok) -> IF(ok, r, NULL)), r -> r IS NOT NULL)"
    return F.expr(f"IF(size({runs}) = 0 OR size({base}) = 0, {runs}, {clear})")


def _pairs(value: str) -> str:
    """SQL for a run's pairs of neighbouring characters as numbers from 0 on."""
    pairs = f"zip_with(slice(chars, 1, size(chars) - 1), slice(chars, 2, size(chars) - 1), (a, b) -> a * {_WIDE} + b)"
    return _let("chars", f"transform(split({value}, ''), c -> instr('{LETTERS}', c))", pairs)


def _base(rows: DataFrame, text: str, name: str, runs: str | None = None) -> DataFrame:
    """``rows`` with column ``name``: what the patterns mark, by start, then kind; and with the matches of ``RUN`` if they get a name."""
    found = free(rows, *(f"found_{k}_" for k in KINDS))
    rows = _find(rows, text, dict(zip(found, (how[0] for how in KINDS.values()))) | ({runs: RUN} if runs else {}))
    parts = ", ".join(_spans(f"`{text}`", f"`{f}`", kind, at, *how) for at, (f, (kind, how)) in enumerate(zip(found, KINDS.items())))
    return rows.withColumn(name, F.expr(f"sort_array(concat({parts}))")).drop(*found)


def _without(text: str, spans: str, mask: str) -> str:
    """SQL for a text with each stretch that spans cover replaced by ``mask``. A stretch begins where as many spans have ended as begun."""
    begins = "filter(transform(opened, (i, k) -> IF(i = 2 * k, i, NULL)), i -> i IS NOT NULL)"
    last = "IF(i = 0, 0, events[i - 1].at)"
    pieces = f"concat(transform({begins}, i -> substring(raw, {last} + 1, events[i].at - {last})), array(substring(raw, element_at(events, -1).at + 1)))"
    joined = f"array_join(transform({pieces}, b -> CAST(b AS STRING)), '{mask}')"
    return _let("raw", f"CAST({text} AS BINARY)", _let("events", _events(f"{spans}.first_byte", f"{spans}.end_byte"), _let("opened", _ranks("events"), joined)))


def train(docs: DataFrame, text_column: str = "text") -> list[float]:
    """For each pair of characters the log-likelihood ratio of the second after the first: random strings over ordinary identifiers.

    Learned from a sample of at most ``SAMPLE_ROWS`` rows. Rows are drawn by their number, so
    that rows of one text come into it as often as any others.
    """
    text, number = free(docs, "text_", "number_")
    rows = docs.select(F.coalesce(F.col(text_column), F.lit("")).alias(text), F.monotonically_increasing_id().alias(number))
    n = rows.count()
    if n > SAMPLE_ROWS:
        # a share that gives at most SAMPLE_ROWS rows, but for less than one case in a million
        rows = rows.filter(F.pmod(F.xxhash64(number, F.lit(3)), F.lit(1_000_000)) < int(1_000_000 * (SAMPLE_ROWS - 5 * SAMPLE_ROWS**0.5) / n))
    base, = free(rows, "base_")
    rows = _base(rows.select(text), text, base)
    marked = F.expr(f"transform(`{base}`, b -> named_struct('value', b.value, 'random', 1))")
    left = f"IF(size(`{base}`) = 0, `{text}`, {_without(f'`{text}`', f'`{base}`', ' ')})"
    ordinary = F.expr(f"transform(array_distinct(regexp_extract_all({left}, '(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{8,}}', 0)), w -> named_struct('value', w, 'random', 0))")
    samples = rows.select(F.explode(F.concat(marked, ordinary)).alias("s")).select("s.value", "s.random").distinct()
    pairs = samples.select("random", F.explode(F.expr(_pairs("value"))).alias("pair"))
    # at most 67 x 67 rows
    counts = {r["pair"]: (r["a"], r["b"]) for r in pairs.groupBy("pair").agg(F.sum("random").alias("a"), F.sum(1 - F.col("random")).alias("b")).collect()}
    ratio = [0.0] * (_WIDE * _WIDE)
    for first in range(_WIDE):
        row = [counts.get(first * _WIDE + k, (0, 0)) for k in range(_WIDE)]
        a, b = sum(r[0] for r in row), sum(r[1] for r in row)
        for k, (x, y) in enumerate(row):
            # random strings are near even over all characters before any is seen
            random = (x + 20.0 / len(LETTERS)) / (a + 20.0)
            plain = (y + 0.5) / (b + 0.5 * len(LETTERS))
            ratio[first * _WIDE + k] = math.log(random) - math.log(plain)
    return ratio


def _ratio(value: str, table: str) -> str:
    return f"aggregate({_pairs(value)}, 0D, (s, p) -> s + element_at({table}, p + 1))"


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", model: list[float] | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, text, base and added spans (start, kind_at, kind, end, value, first_byte, end_byte).

    Without a model, one is trained on a sample of at most ``SAMPLE_ROWS`` of the texts; all texts are scanned.
    """
    model = train(docs, text_column) if model is None else model
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return _mark(rows, "text", model, "base", "added")


def _mark(rows: DataFrame, text: str, model: list[float], base: str, added: str) -> DataFrame:
    table = "CAST(split('" + ",".join(f"{x:.6f}" for x in model) + "', ',') AS array<double>)"
    found, runs = free(rows, "runs_", "apart_")
    rows = _base(rows, text, base, found)
    rows = rows.withColumn(runs, F.expr(f"filter({_spans(f'`{text}`', f'`{found}`', 'model', len(KINDS), RUN, 0, 0)}, r -> r.value RLIKE '[0-9]' AND r.value RLIKE '[A-Za-z]')"))
    rows = rows.withColumn(added, _apart(f"`{runs}`", f"`{base}`"))
    return rows.withColumn(added, F.expr(f"IF(size(`{added}`) = 0, `{added}`, filter(`{added}`, r -> {_ratio('r.value', table)} >= {LEAST_RATIO}))")).drop(found, runs)


def listed(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined, by start, then kind."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def mask_secrets(docs: DataFrame, text_column: str = "text", length_column: str = "n_chars", mask: str = "[SECRET]", model: list[float] | None = None) -> DataFrame:
    """``docs`` with every span of its texts replaced; the length column, if there is one, follows. All rows and columns stay."""
    model = train(docs, text_column) if model is None else model
    text, base, added = free(docs, "text_", "base_", "added_")
    rows = _mark(docs.withColumn(text, F.coalesce(F.col(text_column), F.lit(""))), text, model, base, added)
    new = F.expr(_without(f"`{text}`", f"concat(`{base}`, `{added}`)", mask))
    some = F.expr(f"size(`{base}`) + size(`{added}`) > 0")
    rows = rows.withColumn(text, F.when(some, new).otherwise(F.col(text_column)))
    kept = []
    for c in docs.columns:
        if c == text_column:
            kept.append(F.col(text).alias(c))
        elif c == length_column:
            kept.append(F.when(some, F.char_length(text).cast(docs.schema[c].dataType)).otherwise(F.col(f"`{c}`")).alias(c))
        else:
            kept.append(F.col(f"`{c}`"))
    return rows.select(*kept)
