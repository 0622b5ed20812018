"""A ledger of quality rules: every rule is evaluated once, policies and ablations are bit operations.

Only DataFrame functions are used.  measure() takes each text's measurements inside its own row (no text
is exploded or shuffled), ledger() adds one long whose bit i says that rule i fails, and policies are
masks over these bits, kept as versions.  A policy keeps a row if no bit of its mask is set, so another
policy, or the question what a rule alone costs, needs the stored bits only.

Windows of words are compared by 64-bit hashes inside one text.

Defined cases: a null text counts as an empty one, which has no words and fails the `few_words` rule;
repeated rows and null doc_ids each get a row; an empty table gives an empty table; columns of the input
other than doc_id and text are left aside.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: white space between words, and the characters counted as symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
WINDOW = 5


def _count(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it and wherever the optimiser moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """The number of words inside windows that the text has twice or more."""

    def hashed() -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def places(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(ordered, lambda s: F.sort_array(F.transform(F.filter(s, lambda e, i: (e["h"] == F.get(s, i - 1)["h"]) | (e["h"] == F.get(s, i + 1)["h"])), lambda e: e["i"])))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    none = F.lit(0).cast("long")
    found = _let(hashed(), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), _let(places(g), covered)).otherwise(none))
    return F.when(F.size(words) >= WINDOW, found).otherwise(none)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split("t", "[\\x20\\x09-\\x0D]+"), "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"))
    rows = rows.select(
        "doc_id",
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        _count(F.col("t"), SYMBOLS).alias("n_symbols"),
        _count(F.col("t"), UPPER).alias("n_upper"),
        _count(F.col("t"), LOWER).alias("n_lower"),
        _count(F.col("t"), "!").alias("n_bangs"),
        of_words.alias("of_words"),
        of_lines.alias("of_lines"),
    )
    return rows.select("doc_id", "of_words.n_words", "word_chars", "n_symbols", "of_lines.n_lines", "of_lines.n_dup_lines", "n_upper", "n_lower", "n_bangs", "of_words.n_repeat_words")


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def rules() -> list[Rule]:
    """The rules by bit. A rule's place never changes; new rules are added at the end."""
    n = F.col("n_words")
    return [
        Rule("few_words", n < 10),
        Rule("repeated_words", F.lit(100) * F.col("n_repeat_words") > F.lit(20) * n),
        Rule("many_symbols", F.lit(100) * F.col("n_symbols") > F.lit(10) * n),
        Rule("repeated_lines", F.lit(100) * F.col("n_dup_lines") > F.lit(30) * F.col("n_lines")),
        Rule("shouting", F.col("n_upper") > F.col("n_lower")),
        Rule("many_bangs", F.lit(100) * F.col("n_bangs") > F.lit(30) * n),
        Rule("short_words", F.col("word_chars") < F.lit(2) * n),
        Rule("long_words", F.col("word_chars") > F.lit(20) * n),
    ]


def mask(*names: str) -> int:
    places = {r.name: i for i, r in enumerate(rules())}
    return sum(1 << places[n] for n in names)


@dataclass(frozen=True)
class Policies:
    """Versions of the policy: the names of the rules that reject."""

    versions: dict[int, tuple[str, ...]] = field(
        default_factory=lambda: {
            1: ("few_words", "repeated_words"),
            2: ("few_words", "repeated_words", "many_symbols", "repeated_lines"),
            3: ("few_words", "repeated_words", "many_symbols", "repeated_lines", "shouting", "many_bangs", "short_words", "long_words"),
        }
    )

    @property
    def latest(self) -> int:
        return max(self.versions)

    def keeps(self, version: int | None = None, bits: str = "fail_bits") -> Column:
        return F.col(bits).bitwiseAND(F.lit(mask(*self.versions[version or self.latest]))) == 0


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements with `fail_bits`: bit i is set where rule i fails."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(rule.fails, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("fail_bits", bits)


def ablations(entries: DataFrame, policies: Policies | None = None) -> DataFrame:
    """For each version and rule of it: rows, rows kept, rows that the rule fails, and rows that only it rejects.

    The ledger is counted by its bits first, of which there are 2^rules at most; everything else is done on these counts.
    """
    policies = policies or Policies()
    patterns = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    cases = [(v, name, mask(*names), mask(name)) for v, names in policies.versions.items() for name in names]
    asked = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(name).alias("rule"), F.lit(m).cast("long").alias("mask"), F.lit(b).cast("long").alias("bit")) for v, name, m, b in cases])
    counted = patterns.select("fail_bits", "n", F.inline(asked))
    met = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return counted.groupBy("version", "rule").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(met == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        F.sum(F.when(met.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(met == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.bit_or(met).alias("seen_bits"),
    )
