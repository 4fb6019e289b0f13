"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row (name, measure, low, high); a text passes it if its
measure lies within the bounds.  ``measures`` is a projection of built-in
expressions over one row, so there is no shuffle and no user function.

Words are compared by 64-bit hashes when repeated windows are sought: two
windows count as equal if their three hashes are, which for different windows
of one text happens with odds of about 1 to 2 ** 64 a pair.

Null texts count as empty.  An empty text has no words, so every count is 0,
every ratio is 0 and it fails the rule on length.  Repeated rows are measured
each on its own; columns of the input whose names clash with a measure are
not read and, in ``keep_good``, come back unchanged.  A very long text takes
memory in proportion to its own length; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

STOP_WORDS = (
    "the of and to in is that it for was with be by on as are this an at from or a he not have which "
    "de la le les des et un une du en que est pour dans par sur au pas plus ce qui elle il "
    "der die das und ist von zu den mit ein eine im auf für nicht dem des auch als sich "
    "el los las una se del con su es para al como más lo o y por"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    low: float = float("-inf")
    high: float = float("inf")


#: The production table.  Ratios are per word, per line or per letter.
RULES = (
    Rule("length", "n_words", 50),
    Rule("repeated_windows", "repeat_ratio", high=0.5),
    Rule("mean_word_length", "mean_word_chars", 2, 12),
    Rule("symbols", "symbol_ratio", high=0.1),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("capitals", "upper_ratio", high=0.3),
    Rule("stop_words", "stop_word_ratio", 0.005),
)


def measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns beside every measure that a rule may name."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(common.WORD))
    base = docs.select(*[docs[c] for c in keep], text.alias("_t"))
    # Each projection drops what the next does not need: lines are gone before
    # words are cut, and words live on as one array of longs.
    base = base.select(*keep, "_t", lines.alias("_l"))
    base = base.select(
        *keep,
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        (F.length("_t") - F.regexp_count("_t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.split("_t", common.GAP).alias("_w"),
    )
    done = ["n_lines", "n_dup_lines", "word_chars", "n_symbols", "n_upper"]
    hashed = F.transform(F.filter("_w", lambda w: w != ""), lambda w: F.xxhash64(w))
    base = base.select(*keep, *done, _stop_words("_w").alias("n_stop_words"), hashed.alias("_h"))
    done += ["n_stop_words"]
    n = F.size("_h")
    base = base.select(*keep, *done, n.cast("long").alias("n_words"), "_h", F.length(F.bin(n)).alias("_b"))  # low bits that hold a place in _h
    done += ["n_words"]
    base = base.select(*keep, *done, "_h", "_b", _packed("_h", "_b").alias("_s"))
    base = base.select(*keep, *done, _repeated_positions("_h", "_s", "_b").alias("_p"))
    base = base.select(*keep, *done, _covered("_p").alias("n_repeat_words"))

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    return base.select(
        "*",
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"),
        ratio("word_chars", "n_words").alias("mean_word_chars"),
        ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_upper", "word_chars").alias("upper_ratio"),
        ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
    )


def _stop_words(words: str) -> Column:
    listed = [F.lit(w) for w in STOP_WORDS]
    return F.size(F.filter(F.col(words), lambda w: F.lower(w).isin(*listed))).cast("long")


def _packed(hashes: str, bits: str) -> Column:
    """Sorted longs: high bits hash a three-word window, low bits are its place."""
    h = F.col(hashes)
    n = F.greatest(F.size(h) - 2, F.lit(0))

    def one(x, i):
        window = F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))
        return F.call_function("shiftleft", window, F.col(bits)).bitwiseOR(i.cast("long"))

    return F.sort_array(F.transform(F.slice(h, F.lit(1), n), one))


def _repeated_positions(hashes: str, packed: str, bits: str) -> Column:
    """Sorted places of windows whose three words occur at another place too."""
    h, s, bits = F.col(hashes), F.col(packed), F.col(bits)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

    def place(x):
        return x.bitwiseAND(mask).cast("int")

    def alike(a, b):
        """Whether the windows at a and b have the same three words."""
        i, j = place(a), place(b)
        same = F.call_function("shiftright", a.bitwiseXOR(b), bits) == 0
        for k in range(3):
            same = same & (F.get(h, i + k) == F.get(h, j + k))
        return same

    def met(x, i):
        before, after = F.get(s, i - 1), F.get(s, i + 1)
        return F.coalesce(alike(x, after), F.lit(False)) | F.coalesce(alike(before, x), F.lit(False))

    return F.sort_array(F.transform(F.filter(s, met), place))


def _covered(places: str) -> Column:
    """Words under three-word windows at the sorted ``places``."""
    p = F.col(places)
    steps = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))).cast("long"))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """True where every rule of the table holds."""
    out = F.lit(True)
    for r in rules:
        if r.low != float("-inf"):
            out = out & (F.col(r.measure) >= F.lit(r.low))
        if r.high != float("inf"):
            out = out & (F.col(r.measure) <= F.lit(r.high))
    return out


def broken_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that a text breaks."""
    each = [F.when(~verdict((r,)), F.lit(r.name)) for r in rules]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All measures with ``base_failed``, ``kept`` and ``broken`` for each row."""
    found = measures(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")))
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return found.select("*", base_failed.alias("base_failed"), (~base_failed & verdict(rules)).alias("kept"), broken_rules(rules).alias("broken"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[text_col].alias("text"))
    found = measures(whole, keep=("_row",))
    base_failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    found = found.select("_row", (~base_failed & verdict(rules)).alias("_kept"))
    # A filter would be pushed through the projections, which repeats the
    # measures in it once for every mention; a generator is not.
    return found.select(F.inline(F.when(F.col("_kept"), F.array("_row"))))
