"""Secret scans in DataFrame functions only: patterns, and sliding-window entropy over candidate strings.

Candidates are runs of token characters. A window of fixed width slides over each; the window's Shannon entropy
follows from counts that change by one character in and one out at each step, kept as one sum of whole numbers
(c * log2 c in millionths of a bit), so it does not drift. A window's character class (hexadecimal, lower
case and digits, upper case and digits, base 64) sets the entropy that it must reach and the characters that it
must mix; what a secret is glued to does not change the windows inside it. Windows that reach it are joined into
spans. Candidates that are UUIDs, dates and other numbers are let go, as are windows at a placeholder. Spans of the entropy method that touch a pattern's span are not repeated.

Positions are code points, ends exclusive. A span covers the whole match.

Defined results: a null or empty text has no spans. Repeated rows get the same spans each. Other columns are
not read by `scan` and not changed by `redact`. Documents are judged where they lie: no shuffle.

Work grows in proportion to a text's length and its matches, however long a candidate is: a candidate is taken apart into
characters once, and folds that carry an array go over blocks of BLOCK places, so the array stays short.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import free_names, quoted, text_or_empty
from inkveil.llm.quality import let

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A run that falls short of its length has no later part that reaches it, so the length can stand in the pattern.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/=_-]{{{WINDOW},}}"
#: (class, pattern of a whole window, least bits a character in a window, what a window must hold).
CLASSES = (
    ("hex", "^[0-9a-fA-F]+$", 3.0, ("[0-9]", "[a-fA-F]")),
    ("lower", "^[a-z0-9]+$", 3.6, ("[0-9].*[0-9].*[0-9]", "[a-z]")),
    ("upper", "^[A-Z0-9]+$", 3.6, ("[0-9].*[0-9]", "[A-Z]")),
    ("base64", "", 3.7, ("[0-9]", "[a-z]", "[A-Z]")),
)
ALLOW = (
    "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
    "|^[0-9+/=_-]+$"
)
#: Lets go the windows that it lies in, or next to within WINDOW letters and digits; not the rest of the candidate.
PLACEHOLDER = "(?i)example|placeholder|xxxxx|00000|12345678|abcdefgh"
MASK = "[SECRET]"
#: Places that one fold goes over.
BLOCK = 256
#: Code points that one substring is taken from.
STRETCH = 4096
#: The characters of candidates lie from here on; CELLS counts of BITS bits share a long.
LOWEST, CELLS, BITS = ord("+"), 12, 5
LONGS = -(-(ord("z") - LOWEST + 1) // CELLS)


def blocks(rows: Column) -> Column:
    """The array `rows` in stretches of BLOCK."""
    n = F.size(rows)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda b: F.slice(rows, b + 1, F.lit(BLOCK)))


def running(values: Column, join, zero: int) -> Column:
    """For each of the ints `values` what `join` makes of those before it, from `zero` on."""
    none = F.array().cast("array<int>")

    def fold(xs: Column, start: Column) -> Column:
        init = F.struct(start.alias("at"), none.alias("out"))
        step = lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(xs, init, step, lambda acc: acc["out"])

    def whole(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), lambda a, x: join(a, x)))
        return let(fold(totals, F.lit(zero)), lambda at: F.flatten(F.transform(parts, lambda p, k: fold(p, F.get(at, k)))))

    return let(values, lambda v: let(blocks(v), whole))


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """The matches of `pattern` in order: array of (s, e, g), g the text of `group`."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast("array<struct<s:int,e:int,g:string>>")

    def place(rows: Column) -> Column:
        sizes = F.transform(rows, lambda x: F.length(x["gap"]) + F.length(x["m"]))

        def spans(at: Column) -> Column:
            def span(x: Column, k: Column) -> Column:
                start = F.get(at, k) + F.length(x["gap"])
                return F.struct(start.alias("s"), (start + F.length(x["m"])).alias("e"), x["g"].alias("g"))

            return F.transform(rows, span)

        return let(running(sizes, lambda a, x: a + x, 0), spans)

    rows = let(whole, lambda w: F.arrays_zip(F.slice(gaps, 1, F.size(w)).alias("gap"), w.alias("m"), inner.alias("g")))
    return F.when(text.rlike(pattern), let(rows, place)).otherwise(none)


def entropy_spans(candidate: Column, width: int = WINDOW, classes=CLASSES) -> Column:
    """Array of (s, e) in a candidate string: joined windows that reach their own class's entropy.

    A fold over a block of windows carries how often each character is in the window, counts of BITS bits packed into
    LONGS numbers, and the sum of c * log2 c over them; a step takes one character out and one in."""
    weight = F.array(*[F.lit(round(c * math.log2(c) * 1e6) if c else 0).cast("long") for c in range(width + 2)])

    def budget(k: int) -> int:
        return round(width * (math.log2(width) - classes[k][2]) * 1e6)

    loosest = max(map(budget, range(len(classes))))

    def fits(window: Column, total: Column) -> Column:
        """Whether a window reaches the entropy of its class and holds what that must mix."""

        def reaches(k: int) -> Column:
            out = total <= F.lit(budget(k))
            for p in classes[k][3]:
                out = out & window.rlike(p)
            return out

        out = reaches(len(classes) - 1)
        for k in reversed(range(len(classes) - 1)):
            out = F.when(window.rlike(classes[k][1]), reaches(k)).otherwise(out)
        return out

    def cell(ch: Column) -> Column:
        code = F.ascii(ch) - LOWEST
        shift = (code % CELLS * BITS).cast("int")
        return F.struct(F.floor(code / CELLS).cast("int").alias("k"), shift.alias("s"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("one"))

    def count(counts: Column, x: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, x["k"]), x["s"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def hits(chars: Column, cells: Column, start: Column) -> Column:
        """The places of the windows that count, of BLOCK windows from `start` on."""

        def text(first: Column, size: Column) -> Column:
            return F.array_join(F.slice(chars, first + 1, size), "")

        def named(first: Column) -> Column:
            """Whether a placeholder lies in the window at `first` or beside it, with no separator between."""
            from_ = F.greatest(first - width, F.lit(0))
            before = F.regexp_extract(text(from_, first - from_), "[A-Za-z0-9]*$", 0)
            after = F.regexp_extract(text(first + width, F.lit(width)), "^[A-Za-z0-9]*", 0)
            return F.concat(before, text(first, F.lit(width)), after).rlike(PLACEHOLDER)

        def step(acc: Column, t: Column) -> Column:
            """t: the place of the character that enters, from 0."""
            enters, leaves, full = F.get(cells, t), F.get(cells, t - width), t - width >= start

            def moved(x: Column, k: Column) -> Column:
                more = F.when(k == enters["k"], enters["one"]).otherwise(F.lit(0).cast("long"))
                less = F.when(full & (k == leaves["k"]), leaves["one"]).otherwise(F.lit(0).cast("long"))
                return x + more - less

            def judged(counts: Column) -> Column:
                was, now = count(acc["n"], leaves), count(counts, enters)
                lost = F.when(full, F.get(weight, was - 1) - F.get(weight, was)).otherwise(F.lit(0).cast("long"))
                first = t - (width - 1)

                def told(total: Column) -> Column:
                    hit = (first >= start) & (total <= F.lit(loosest)) & fits(text(first, F.lit(width)), total) & ~named(first)
                    out = F.when(hit, F.concat(acc["out"], F.array(first))).otherwise(acc["out"])
                    return F.struct(total.alias("w"), counts.alias("n"), out.alias("out"))

                return let(acc["w"] + lost + F.get(weight, now) - F.get(weight, now - 1), told)

            return let(F.transform(acc["n"], moved), judged)

        init = F.struct(F.lit(0).cast("long").alias("w"), F.array_repeat(F.lit(0).cast("long"), LONGS).alias("n"), F.array().cast("array<int>").alias("out"))
        last = F.least(start + (BLOCK + width - 2), F.size(chars) - 1)
        return F.aggregate(F.sequence(start, last), init, step, lambda acc: acc["out"])

    def joined(found: Column) -> Column:
        """Windows that touch are one span."""
        first = F.filter(found, lambda x, k: F.coalesce(x - F.get(found, k - 1) > width, F.lit(True)))
        last = F.filter(found, lambda x, k: F.coalesce(F.get(found, k + 1) - x > width, F.lit(True)))
        return F.zip_with(first, last, lambda s, e: F.struct(s.alias("s"), (e + width).alias("e")))

    def slide(chars: Column) -> Column:
        windows = F.size(chars) - width + 1
        starts = F.when(windows > 0, F.sequence(F.lit(0), windows - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(chars, cell), lambda cells: let(F.flatten(F.transform(starts, lambda b: hits(chars, cells, b))), joined))

    return let(F.regexp_extract_all(candidate, F.lit("(?s)."), F.lit(0)), slide)


def _as_spans(found: Column, kind: str) -> Column:
    return F.transform(
        found, lambda m: F.struct(m["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), m["e"].alias("e"))
    )


def base_spans(text: Column) -> dict[str, Column]:
    assign = F.filter(located(text, ASSIGN, 2), lambda m: F.length(m["g"]) >= 6)
    return {
        "assign": _as_spans(assign, "assign"),
        "access": _as_spans(located(text, ACCESS), "access"),
        "hex": _as_spans(located(text, HEX), "hex"),
    }


def added_spans(text: Column, base: Column) -> Column:
    """Spans of the entropy method, those that touch a base span left out."""
    candidates = F.filter(located(text, CANDIDATE), lambda m: ~m["g"].rlike(ALLOW))
    spans = F.flatten(
        F.transform(
            candidates,
            lambda m: F.transform(
                entropy_spans(m["g"]), lambda x: F.struct((m["s"] + x["s"]).alias("s"), (m["s"] + x["e"]).alias("e"))
            ),
        )
    )

    def free(every: Column) -> Column:
        """Spans of the method do not overlap one another: a base span touches one if it is next, or reaches into it from before."""
        base_end = F.transform(every, lambda x: F.when(x["k"] < KINDS.index("entropy"), x["e"]).otherwise(0))

        def alone(x: Column, k: Column, reach: Column) -> Column:
            after = F.get(every, k + 1)
            return (F.get(reach, k) <= x["s"]) & ~F.coalesce((after["k"] < KINDS.index("entropy")) & (after["s"] < x["e"]), F.lit(False))

        return let(running(base_end, F.greatest, 0), lambda reach: F.filter(every, lambda x, k: (x["k"] == KINDS.index("entropy")) & alone(x, k, reach)))

    return F.when(F.size(base) == 0, _as_spans(spans, "entropy")).otherwise(let(F.sort_array(F.concat(base, _as_spans(spans, "entropy"))), free))


def _labels(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id, n_assign, n_access, n_hex, base_sha256, spans (text) and span_list (array of
    (s, k, e), k an index into KINDS), in order of start and kind."""
    rows = df.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    found = base_spans(F.col("__text"))
    rows = rows.select(id_col, "__text", *[c.alias(f"__{k}") for k, c in found.items()])
    rows = rows.withColumn("__base", F.sort_array(F.concat("__assign", "__access", "__hex")))
    rows = rows.withColumn("span_list", F.sort_array(F.concat("__base", added_spans(F.col("__text"), F.col("__base")))))
    return rows.select(
        id_col,
        *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in found],
        F.sha2(_labels(F.col("__base")), 256).alias("base_sha256"),
        _labels(F.col("span_list")).alias("spans"),
        "span_list",
    )


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mask: str = MASK) -> DataFrame:
    """`df` with each secret in its texts replaced by `mask`; spans that overlap are replaced as one. The length
    column, where there is one, is set anew for the texts that changed."""
    text = F.col(text_col)
    whole = text_or_empty(text_col)

    def all_spans(t: Column) -> Column:
        found = base_spans(t)
        return let(F.concat(*found.values()), lambda b: F.sort_array(F.concat(b, added_spans(t, b))))

    def joined(spans: Column) -> Column:
        def groups(reach: Column) -> Column:
            """A span that begins beyond all ends before it begins a group; the last of a group ends it."""
            rows = F.transform(spans, lambda x, k: F.struct(x["s"].alias("s"), F.greatest(x["e"], F.get(reach, k)).alias("e"), (F.get(reach, k) < x["s"]).alias("new")))
            ends = lambda r: F.filter(r, lambda x, k: F.coalesce(F.get(r, k + 1)["new"], F.lit(True)))
            return let(rows, lambda r: F.zip_with(F.filter(r, lambda x: x["new"]), ends(r), lambda x, y: F.struct(x["s"].alias("s"), y["e"].alias("e"))))

        return let(running(F.transform(spans, lambda x: x["e"]), F.greatest, -1), groups)

    def cut(spans: Column) -> Column:
        def kept(stretches: Column) -> Column:
            def between(a: Column, b: Column) -> Column:
                """Code points a to b - 1, taken from the stretches that hold them."""

                def piece(k: Column) -> Column:
                    low = F.greatest(a - k * STRETCH, F.lit(0))
                    return F.substring(F.get(stretches, k), low + 1, F.least(b - k * STRETCH, F.lit(STRETCH)) - low)

                first, last = F.floor(a / STRETCH).cast("int"), F.floor((b - 1) / STRETCH).cast("int")
                return F.when(b <= a, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), piece), ""))

            def head(x: Column, k: Column) -> Column:
                return F.concat(between(F.coalesce(F.get(spans, k - 1)["e"], F.lit(0)), x["s"]), F.lit(mask))

            return F.concat(F.array_join(F.transform(spans, head), ""), between(F.element_at(spans, -1)["e"], F.length(whole)))

        stretched = let(F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), kept)
        return F.when(F.size(spans) == 0, text).otherwise(stretched)

    fresh = let(all_spans(whole), lambda s: let(joined(s), cut))
    names = df.columns
    (made,) = free_names(df, "__fresh")
    out = df.withColumn(made, fresh)
    changed = F.col(made) != text

    def column(name: str) -> Column:
        if name == text_col:
            return F.col(made).alias(name)
        if name == length_col:
            kind = dict(df.dtypes)[name]
            return F.when(changed, F.length(made).cast(kind)).otherwise(F.col(quoted(name))).alias(name)
        return F.col(quoted(name))

    return out.select(*[column(n) for n in names])
