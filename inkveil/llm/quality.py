"""Quality rules: a table of thresholds compiled into one projection of Spark expressions.

Each rule is a row (name, measure, least, most). The measures are lengths, symbol ratios, the ratio of stop words and
line ratios of a whole text; `compile_rules` turns the table into one boolean expression, so a document
is read once and judged where it lies: no user function, no shuffle.

Defined results: a null text has no words and fails; an empty text likewise. A ratio whose divisor is zero
is 0. Repeated rows get the same verdict each. Nulls in other columns and additional columns do not matter.
Work and memory for a document grow as n log n with its words; nothing is cut off.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import WS, WS_CHARS, quoted, text_or_empty, words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it for with as was on be by are this have from or an at not "
    "der die das und den von zu mit sich des auf ist im dem nicht ein eine als auch es für "
    "le la les des et en un une du que qui dans pour pas sur au par est il sont avec "
    "el los las de y un una por con no para su al lo como más pero sus se del"
).split()


@dataclass(frozen=True)
class Rule:
    """A document passes if least <= measure <= most; None leaves a side open."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: The production table. The first two rows are the base rules; the others judge what these let through.
RULES = (
    Rule("enough_words", "n_words", least=50),
    Rule("repeated_windows", "repeat_percent", most=50),
    Rule("word_length", "mean_word_length", least=2, most=15),
    Rule("symbols", "symbols_per_word", most=0.3),
    Rule("stop_words", "stop_word_ratio", least=0.01),
    Rule("repeated_lines", "dup_line_ratio", most=0.5),
)
BASE_RULES = ("enough_words", "repeated_windows")


def let(value: Column, body) -> Column:
    """Binds `value` to a name, so that it is computed once: expressions are otherwise inlined wherever used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window_words(ws: Column, width: int = 3) -> Column:
    """Number of words that lie in a window of `width` words found at least twice in the array `ws`.

    All hashes distinct means all windows distinct, so most texts end there. Otherwise the places are sorted by
    hash; neighbours of one hash are compared by their words, and the places that repeats cover are counted."""
    n = F.size(ws) - F.lit(width - 1)

    def hashes(h: Column) -> Column:
        out = F.slice(h, F.lit(1), n)
        for k in range(1, width):
            out = F.zip_with(out, F.slice(h, F.lit(k + 1), n), lambda a, b: F.xxhash64(a, b))
        return out

    def twins(s: Column, field: str) -> Column:
        def same(x: Column, y: Column) -> Column:
            return F.coalesce(x[field] == y[field], F.lit(False))

        return F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))

    def with_words(x: Column) -> Column:
        window = F.concat_ws(" ", *[F.get(ws, x["i"] + k) for k in range(width)])
        return F.struct(window.alias("w"), x["i"].alias("i"))

    def covered(d: Column) -> Column:
        gaps = F.transform(d, lambda x, k: F.least(F.lit(width), F.coalesce(F.get(d, k + 1)["i"] - x["i"], F.lit(width))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def repeats(h: Column) -> Column:
        ordered = F.sort_array(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i")))
        exact = let(ordered, lambda s: let(F.sort_array(F.transform(twins(s, "h"), with_words)), lambda t: twins(t, "w")))
        places = F.array_sort(exact, lambda x, y: x["i"] - y["i"])
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places, covered))

    counted = let(F.transform(ws, lambda w: F.xxhash64(w)), lambda h: let(hashes(h), repeats))
    return F.when(F.size(ws) < width, F.lit(0)).otherwise(counted)


def measures(text: Column, ws: Column) -> dict[str, Column]:
    """The measures of a text `text` with the words `ws`."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WS_CHARS))) > 0)
    return {
        "n_words": F.size(ws).cast("long"),
        "word_chars": F.length(F.regexp_replace(text, WS, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_distinct_lines": F.size(F.array_distinct(lines)).cast("long"),
        "n_repeat_words": repeated_window_words(ws).cast("long"),
        "n_stop_words": F.size(F.filter(ws, lambda w: w.isin(*STOP_WORDS))).cast("long"),
    }


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


#: Ratios over a struct of the measures above.
RATIOS = {
    "n_dup_lines": lambda m: m["n_lines"] - m["n_distinct_lines"],
    "mean_word_length": lambda m: _ratio(m["word_chars"], m["n_words"]),
    "symbols_per_word": lambda m: _ratio(m["n_symbols"], m["n_words"]),
    "stop_word_ratio": lambda m: _ratio(m["n_stop_words"], m["n_words"]),
    "dup_line_ratio": lambda m: _ratio(m["n_lines"] - m["n_distinct_lines"], m["n_lines"]),
    "repeat_percent": lambda m: _ratio(100 * m["n_repeat_words"], m["n_words"]),
}


def measured(text: Column) -> Column:
    """A struct of the measures of `text`, which is read into words once."""
    return let(words(text), lambda ws: F.struct(*[c.alias(k) for k, c in measures(text, ws).items()]))


def compile_rules(m: Column, rules: tuple[Rule, ...]) -> Column:
    """One boolean expression over the struct of measures `m`: true where every rule holds."""
    out = F.lit(True)
    for r in rules:
        value = RATIOS[r.measure](m) if r.measure in RATIOS else m[r.measure]
        if r.least is not None:
            out = out & (value >= F.lit(r.least))
        if r.most is not None:
            out = out & (value <= F.lit(r.most))
    return out


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of `df`: its id, measures, ratios, `base_failed` and `kept`."""
    base = tuple(r for r in rules if r.name in BASE_RULES)

    def judged(m: Column) -> Column:
        return F.struct(
            m.alias("m"),
            *[f(m).alias(k) for k, f in RATIOS.items()],
            (~compile_rules(m, base)).alias("base_failed"),
            compile_rules(m, rules).alias("kept"),
        )

    rows = df.select(F.col(quoted(id_col)), let(measured(text_or_empty(quoted(text_col))), judged).alias("q"))
    return rows.select(quoted(id_col), "q.m.*", *[f"q.{k}" for k in (*RATIOS, "base_failed", "kept")])


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of `df` that pass, with their own columns only."""
    return df.where(let(measured(text_or_empty(quoted(text_col))), lambda m: compile_rules(m, rules)))
