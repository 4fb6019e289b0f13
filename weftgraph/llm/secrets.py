"""Secret scans: candidates judged by a random forest.

Candidates are matches of ``CANDIDATE``: assigned values (``name = "..."``,
``name=...``), prefixed keys and long runs of key characters.  A forest of
decision trees, trained from labelled findings, removes the false positives.
Features of a candidate are its length, its transitions between kinds of
characters, the share of it that common letter groups and words cover
(dictionary coverage), whether it looks like a path or address, and the words
beside it.  The trained trees are compiled into one CASE expression each, so
scoring is a projection of built-in expressions without shuffle or Python.

Findings are rows ``before, candidate, after, label`` (1 a secret).  Where a
caller has none, ``drawn_findings`` draws a bounded, seeded set by SQL:
random keys, tokens and passwords against hashes of files and commits,
identifiers, paths, numbers, placeholders and prose.

The drawn kinds are templates.  How far the forest carries beyond them is
tested by leaving whole kinds out of training (``kind``), and on documents.

Null and empty texts have no candidates and give no row.  Repeated rows give
their findings each; null ids are kept as null.  A value or run of any length
is one candidate, whole; other columns, whatever their names, are not read; an
empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FINDINGS = 6_000
TREES, DEPTH = 15, 6
THRESHOLD = 0.5

_KEYWORD = r"(?i:pass|secret|token|api[_-]?key|credential|auth)"
#: A whole run of name characters that holds a keyword; looked at once, from its start.
_NAME = rf"(?<![A-Za-z_.-])(?=[A-Za-z_.-]*?{_KEYWORD})[A-Za-z_.-]++"
CANDIDATE = (
    rf"{_NAME}\s{{0,3}}[=:]\s{{0,3}}[\"']?[^\s\"'<>&]{{8,}}+"
    r"|(?<![A-Za-z0-9_])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9_])(?:ghp|gho|ghs|ghu|glpat|xox[abp]|sk|pk|rk)[_-][A-Za-z0-9_-]{16,}+"
    r"|(?<![A-Za-z0-9+/=_.@-])[A-Za-z0-9+/=_-]{20,}+(?![A-Za-z0-9+/=_@-])"
)
#: What every text with a candidate holds: cheap to refuse most texts by.
_NEEDED = rf"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{{18,}}+|{_KEYWORD}[A-Za-z_.-]*+\s{{0,3}}[=:]"
_VALUE = rf"^{_NAME}\s{{0,3}}[=:]\s{{0,3}}[\"']?"
#: Words and letter groups of common prose and names; what they cover of a candidate is not random.
DICTIONARY = (
    "tion ment ness able ible ing the and for that with this from have not are was pass word example change "
    "test user name file path data index main default config license version public private http www com org "
    "class function return value string number list object error message service server client request "
    "ung lich keit heit sch ein ver der die das que eau aux oir ent eur ais cion ado ento mente dad los las "
    "er en re on an in at ti or st es th nd ha ed ou ea to it is wh ly sh"
).split()

FEATURES = ("length", "transitions", "digit_share", "upper_share", "distinct_share", "coverage", "pathlike", "named", "known_prefix", "hashlike", "beside")


def _share(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))


def features(df: DataFrame) -> DataFrame:
    """``df`` (before, candidate, after) with its FEATURES, all doubles."""
    c, before = F.col("_value"), F.lower(F.col("before"))
    df = df.withColumn("_value", F.regexp_replace("candidate", _VALUE, ""))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A"), "[^0aA]+", "-")
    common_groups = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    left = F.regexp_replace(F.lower(c), common_groups, "")
    made = {
        "length": F.length(c),
        "transitions": (F.length(shape) - 1) / F.greatest(F.length(c), F.lit(1)),
        "digit_share": _share(c, "[0-9]"),
        "upper_share": _share(c, "[A-Z]"),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / F.greatest(F.length(c), F.lit(1)),
        "coverage": 1 - F.length(left) / F.greatest(F.length(c), F.lit(1)),
        "pathlike": F.col("candidate").rlike(r"/[A-Za-z_.-]+/|\.[a-z]{1,4}$|://").cast("int"),
        "named": F.col("candidate").rlike(_VALUE).cast("int"),
        "known_prefix": c.rlike("^(AKIA|ASIA|gh[posu]_|glpat-|xox[abp]-|sk[_-]|rk[_-])").cast("int"),
        "hashlike": (before.rlike(r"(commit|sha\d*|md5|hash|digest|checksum|etag|revision|integrity)\W*$") | c.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-")).cast("int"),
        "beside": (before.rlike(r"(key|token|secret|password|bearer|credential|login)\W*$") | F.lower("after").rlike(r"^\W*(key|token|secret)")).cast("int"),
    }
    return df.withColumns({k: v.cast("double") for k, v in made.items()}).drop("_value")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, before, candidate, after``; start from 0, at most 40 characters of the words on either side."""
    base = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("_t")).filter(F.col("_t").rlike(_NEEDED))
    cut = base.select("doc_id", F.regexp_extract_all("_t", F.lit(CANDIDATE), 0).alias("m"), F.split("_t", CANDIDATE, -1).alias("p"))
    sizes = F.zip_with("p", "m", lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
    cut = cut.withColumn("z", F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n))))
    each = cut.select("doc_id", "p", "z", F.posexplode("m").alias("i", "candidate"))
    return each.select(
        "doc_id",
        (F.get("z", F.col("i")) + F.length(F.get("p", F.col("i")))).cast("long").alias("start"),
        F.right(F.get("p", F.col("i")), F.lit(40)).alias("before"),
        "candidate",
        F.left(F.get("p", F.col("i") + 1), F.lit(40)).alias("after"),
    )


def drawn_findings(spark: SparkSession, n: int = FINDINGS) -> DataFrame:
    """``before, candidate, after, label, kind``: a seeded set of ``n`` labelled findings, half of them secrets."""
    i = F.col("id")
    h = lambda k: F.sha2(F.concat_ws("|", i.cast("string"), F.lit(k)), 256)
    b64 = lambda k: F.regexp_replace(F.base64(F.unhex(h(k))), "[+/=]", "")
    pick = lambda k, xs: F.get(F.array(*[F.lit(x) for x in xs]), F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(xs))).cast("int"))
    syllables = [w for w in DICTIONARY if 2 <= len(w) <= 4 and w.isalpha()]
    word = F.concat(*[pick(f"w{k}", syllables) for k in range(10)])
    upper = F.translate(F.upper(F.substring(h("k"), 1, 16)), "0189", "WXYZ")
    name = pick("name", ["token", "password", "secret", "api_key", "auth_token", "access_token"])
    length = F.pmod(F.xxhash64(i, F.lit("n")), F.lit(30)).cast("int")
    uuid = F.concat_ws("-", *[F.substring(h("u"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    secret = [
        (2, "cloud key", F.concat(pick("p", ["AKIA", "ASIA"]), upper)),
        (4, "named uuid", F.concat(name, pick("q", [' = "', "=", ": ", "='"]), uuid)),
        (6, "named hex", F.concat(name, pick("q", [' = "', "=", ": ", "='"]), F.substring(h("s"), F.lit(1), length + 12))),
        (9, "named base64", F.concat(name, pick("q", [' = "', "=", ": "]), F.substring(b64("s"), F.lit(1), length + 10))),
        (11, "prefixed token", F.concat(pick("g", ["ghp_", "glpat-", "xoxb-", "sk_"]), F.substring(b64("g"), 1, 36))),
        (14, "bare base64", F.substring(b64("r"), 1, 40)),
    ]
    other = [
        (2, "digest", F.substring(h("f"), F.lit(1), pick("l", ["40", "64"]).cast("int"))),
        (3, "uuid", uuid),
        (5, "long word", word),
        (6, "path", F.concat(F.lit("src/"), pick("d", ["main", "lib", "test"]), F.lit("/"), word)),
        (8, "class name", F.concat(F.initcap(pick("a", syllables)), F.initcap(word), F.lit("Service"))),
        (9, "placeholder", F.concat(name, F.lit("="), pick("x", ["changeme123", "your_password_here", "<placeholder>", "xxxxxxxxxxxx", "example_token_value", "************"]))),
        (11, "snake name", F.concat_ws("_", pick("a", syllables), word, pick("b", syllables))),
        (12, "number", F.substring(F.regexp_replace(h("d"), "[a-f]", ""), 1, 22)),
        (13, "named word", F.concat(name, F.lit(": "), word)),
        (14, "rule", F.rpad(F.lit(""), 24 + length, pick("r", ["=", "-", "_", "ab", "0"]))),
    ]

    def chosen(kinds, what):
        out = None
        for below, kind, text in kinds:
            value = text if what == "text" else F.lit(kind)
            out = F.when(i % 14 < below, value) if out is None else out.when(i % 14 < below, value)
        return out

    hash_word = pick("hw", ["commit ", "sha256:", "md5 ", "checksum: ", "digest sha1-"])
    label = (i % 2).cast("int")
    before = F.when((label == 0) & (F.floor(i / 2) % 14 < 2), hash_word).otherwise(F.concat(word, F.lit(" "), pick("t", syllables), F.lit(" ")))
    half = spark.range(n).withColumn("id2", F.floor(i / 2)).withColumn("label", label).withColumn("before", before)
    rows = half.withColumn("id", F.col("id2"))
    pair = lambda what: F.when(F.col("label") == 1, chosen(secret, what)).otherwise(chosen(other, what))
    return rows.select("before", pair("text").alias("candidate"), pick("t2", [" and", ".", "\n", '"', " of"]).alias("after"), "label", pair("kind").alias("kind"))


def _compiled(lines: list[str]) -> str:
    """SQL of one tree from its printed form (If/Else/Predict lines)."""
    import re

    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at].strip()
        at += 1
        if line.startswith("Predict:"):
            return str(float(line.split(":")[1]))
        f, op, value = re.match(r"If \(feature (\d+) (<=|>) ([^)]+)\)", line).groups()
        yes = node()
        at += 1  # the Else line
        return f"CASE WHEN {FEATURES[int(f)]} {op} {value}D THEN {yes} ELSE {node()} END"

    return node()


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 7) -> str:
    """A random forest as one SQL expression over FEATURES: the share of trees that say secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(features(findings)).select("x", F.col("label").cast("double").alias("label"))
    model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(rows)
    each = [_compiled([x for x in t.toDebugString.split("\n")[1:] if x.strip()]) for t in model.trees]
    return f"({' + '.join(each)}) / {float(trees)}"


def secrets(docs: DataFrame, forest: str, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, candidate, score, kept`` of every candidate."""
    found = features(candidates(docs, id_col, text_col)).withColumn("score", F.expr(forest))
    return found.select("doc_id", "start", "candidate", F.col("score"), (F.col("score") >= threshold).alias("kept"))
