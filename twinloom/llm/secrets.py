"""Secret scan: a random forest over candidate strings (DataFrame functions and Spark ML only).

A candidate is a run of 12 or more letters, digits and ``+ / _ -`` in a token,
with a digit or 12 capitals in a row; a token can hold several. The forest judges it by length, shares of
character classes, changes between them, distinct characters, how much of it a
dictionary covers, the path it stands in, and the words around it.

The forest is trained from labelled findings: candidates with a 0/1 label. Where
no human labels exist, :func:`labelled_by_rule` makes findings from one format
and from assignments to a secret's name. Such a name is also among the features;
so that the forest does not merely repeat the rule it learns from each finding
twice, as it stands and with the name it is assigned to hidden (:func:`nameless`).

Corpora may lack whole kinds of harmless identifiers, so :func:`made_up` findings
of some are learned from as well.

Candidates are never written to a shared folder: the bounded sample that is
trained on is held in memory, and the result has digests in place of values.

Edge cases: null and empty texts have no candidates; a null path is a path of its
own; rows that repeat are scanned each; without findings of both labels the score
is the share of secrets among the findings (0 if there are none); an empty table
gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinloom.llm.common import SPACES

#: Findings that the forest is trained on (about; chosen by a hash, up to half of them for the rarer label), and words of its dictionary.
MAX_TRAIN = 4_000
MAX_WORDS = 1_000
#: Made-up findings of each label.
MADE_UP = 200
TREES, DEPTH = 40, 8
THRESHOLD = 0.5
#: Characters of the words before a token that go with its second run and later ones (its first has them whole).
AROUND = 128

_RUN = r"[A-Za-z0-9+/_-]{12,}"
_ODD = r"[0-9]|[A-Z]{12}"
# Words that go with secrets, and words that go with harmless identifiers.
SECRET_WORDS = "password|passwd|pwd|secret|token|key|auth|bearer|credential|api"
HARMLESS_WORDS = "sha|md5|commit|uuid|hash|checksum|digest|build|version|order|invoice|card"
#: Fixed value: the format of one provider's access keys.
ACCESS_KEY = r"^AKIA[0-9A-Z]{16}$"

FEATURES = [
    "length", "digits", "upper", "lower", "symbols", "changes", "distinct", "hex", "covered", "assigned", "secret_words", "harmless_words", "slashes", "path_slot",
]


def candidates(docs: DataFrame, path_col: str = "source") -> DataFrame:
    """doc_id, path, word (index of the token), value, before, after: one row a candidate.

    What stands before and after a run of a token with several is the run next to it and what is between; the first
    also has the words before the token, the last those after it.
    """
    text = F.col("text")
    tokens = F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), SPACES)
    found = F.filter(
        F.transform("tokens", lambda t, i: F.struct(i.alias("word"), t.alias("token"))),
        lambda x: (F.length(x["token"]) >= 12) & x["token"].rlike(_ODD) & x["token"].rlike(_RUN),
    )
    around = F.transform(
        "found",
        lambda x: F.struct(
            x["word"].alias("word"),
            x["token"].alias("token"),
            F.array_join(F.slice("tokens", F.greatest(x["word"] - 3, F.lit(0)) + 1, F.least(x["word"], F.lit(3))), " ").alias("before"),
            F.array_join(F.slice("tokens", x["word"] + 2, 2), " ").alias("after"),
        ),
    )
    likely = docs.where(text.rlike(_ODD)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(path_col).alias("path"), tokens.alias("tokens"))
    each = likely.withColumn("found", found).where(F.size("found") > 0).select("doc_id", "path", F.explode(around).alias("c"))
    runs, gaps = F.regexp_extract_all("c.token", F.lit(_RUN), F.lit(0)), F.split("c.token", _RUN)
    each = each.withColumns({"runs": runs, "gaps": gaps}).select("*", F.posexplode("runs").alias("at", "value")).where(F.col("value").rlike(_ODD))
    at, gap = F.col("at"), F.get("gaps", F.col("at"))
    first, last = at == 0, at == F.size("runs") - 1
    before = F.when(first, F.col("c.before")).otherwise(F.concat(F.right("c.before", F.lit(AROUND)), F.lit(" "), F.get("runs", at - 1)))
    after = F.when(last, F.col("c.after")).otherwise(F.concat(F.get("gaps", at + 1), F.get("runs", at + 1)))
    return each.select(
        "doc_id",
        "path",
        F.col("c.word").cast("long").alias("word"),
        "value",
        F.concat(before, F.when(first, F.lit(" ")).otherwise(F.lit("")), gap).alias("before"),
        after.alias("after"),
    )


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def with_features(found: DataFrame, dictionary: list[str]) -> DataFrame:
    """``found`` with the columns of FEATURES."""
    parts = F.split(F.lower("value"), "[^a-z]+")
    known = F.filter(parts, lambda w: w.isin(dictionary)) if dictionary else F.array().cast("array<string>")
    covered = F.aggregate(known, F.lit(0), lambda a, w: a + F.length(w)) / F.length("value")
    changes = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    return found.withColumns(
        {
            "length": F.length("value").cast("double"),
            "digits": _share("[0-9]"),
            "upper": _share("[A-Z]"),
            "lower": _share("[a-z]"),
            "symbols": _share("[+/_-]"),
            "changes": _share(changes),
            "distinct": F.size(F.array_distinct(F.split("value", ""))) / F.length("value"),
            "hex": F.col("value").rlike("^[0-9a-f]+$").cast("double"),
            "covered": covered,
            "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
            "secret_words": F.regexp_count(F.lower("before"), F.lit(SECRET_WORDS)).cast("double"),
            "harmless_words": F.regexp_count(F.lower(F.concat("before", F.lit(" "), "after")), F.lit(HARMLESS_WORDS)).cast("double"),
            "slashes": F.regexp_count("value", F.lit("/")).cast("double"),
            "path_slot": F.coalesce(F.crc32(F.col("path").cast("binary")) % 16, F.lit(-1)).cast("double"),
        }
    )


def labelled_by_rule(found: DataFrame) -> DataFrame:
    """``found`` with a label: 1 for access keys and for values assigned to a secret's name."""
    capital = "|".join(w.capitalize() for w in SECRET_WORDS.split("|"))  # access_token, AWS_SECRET_ACCESS_KEY and accessToken are names too
    named = F.col("before").rlike(rf"((?<![A-Za-z0-9])(?i:{SECRET_WORDS})|(?<=[a-z0-9])({capital}))\w*[\"']?\s*[=:]\s*[\"']?$")
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")
    return found.withColumn("label", (F.col("value").rlike(ACCESS_KEY) | (named & mixed)).cast("int"))


def made_up(spark: SparkSession, n: int = MADE_UP) -> DataFrame:
    """``n`` findings of harmless identifiers and as many of secrets, with labels and without a path."""
    x = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 512)
    kind = F.col("id") % 5
    digits = F.translate(x("d"), "abcdef", "012345")
    mixed = F.regexp_replace(F.base64(F.unhex(x("m"))), "[+/=]", "")
    dashes = F.concat_ws("-", *[F.substring(x("u"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    names = lambda *words: F.element_at(F.array(*map(F.lit, words)), (kind + 1).cast("int"))
    harmless = F.when(kind == 0, F.substring(x("h"), 1, 40)).when(kind == 1, F.substring(x("h"), 1, 64)).when(kind == 2, dashes).when(kind == 3, F.substring(digits, 1, 14)).otherwise(F.substring(x("h"), 1, 32))
    secret = F.when(kind < 2, F.substring(mixed, 1, 32)).when(kind == 2, F.substring(mixed, 1, 20)).when(kind == 3, F.substring(x("s"), 1, 32)).otherwise(F.concat(F.lit("AKIA"), F.upper(F.substring(x("s"), 1, 16))))
    shared = [(-1 - F.col("id")).alias("doc_id"), F.lit(0).cast("long").alias("word"), F.lit(None).cast("string").alias("path")]
    rows = spark.range(n)
    return rows.select(
        *shared, harmless.alias("value"), names("the commit ", "with checksum sha256:", "its uuid ", "your order ", "digest md5=").alias("before"), F.lit("was seen").alias("after"), F.lit(0).alias("label")
    ).unionByName(rows.select(*shared, secret.alias("value"), names("the api_key=", "auth token: ", "password=", "client_secret=", "access key ").alias("before"), F.lit("was seen").alias("after"), F.lit(1).alias("label")))


def nameless(found: DataFrame) -> DataFrame:
    """``found`` without the names and signs that its values are assigned by."""
    return found.withColumn("before", F.regexp_replace("before", r"[\w.-]*[\"']?\s*[=:]+\s*[\"']?$", ""))


class Forest:
    """The dictionary, and the trained forest or (without one) a constant score."""

    def __init__(self, dictionary: list[str], model: RandomForestClassificationModel | None, constant: float):
        self.dictionary, self.model, self.constant = dictionary, model, constant

    def score(self, found: DataFrame) -> DataFrame:
        """``found`` with a score."""
        if self.model is None:
            return found.withColumn("score", F.lit(self.constant))
        rows = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(with_features(found, self.dictionary))
        scored = self.model.transform(rows).withColumn("score", F.round(vector_to_array("_p")[1], 9))
        return scored.select(*found.columns, "score")


def train(findings: DataFrame, max_train: int = MAX_TRAIN, seed: int = 7) -> Forest:
    """A forest from findings (columns of :func:`candidates` and label), about ``max_train`` of them.

    Each label is drawn at its own rate, so that rare secrets stay in the sample; weights of one by that rate keep the
    labels' shares as they are among all findings.
    """
    labelled = findings.where("label is not null").select("doc_id", "word", "path", "value", "before", "after", "label")
    n = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    total, secret = sum(n.values()), n.get(1, 0)
    if not secret or secret == total:
        return Forest([], None, float(bool(secret)))
    rarer = min(n, key=n.get)
    share = min(n[rarer], max_train // 2)
    rate = {x: min(1.0, (share if x == rarer else max_train - share) / n[x]) for x in n} if total > max_train else dict.fromkeys(n, 1.0)
    own_rate = F.when(F.col("label") == rarer, rate[rarer]).otherwise(rate[1 - rarer])
    kept = F.pmod(F.xxhash64("doc_id", "word", "value", "before"), F.lit(1_000_000_000)) < own_rate * 1_000_000_000
    sample = labelled.where(kept).persist(StorageLevel.MEMORY_ONLY)  # about max_train rows; never on disk
    try:
        word = F.explode(F.split(F.lower(F.concat("before", F.lit(" "), "after")), "[^a-z]+")).alias("w")
        common = sample.select(word).where(F.length("w").between(3, 20)).groupBy("w").count().orderBy(F.col("count").desc(), "w").limit(MAX_WORDS)
        dictionary = [r.w for r in common.collect()]
        every = sample.select("*", (F.lit(1.0) / own_rate).alias("weight")).unionByName(made_up(findings.sparkSession).withColumn("weight", F.lit(1.0)))
        both = every.unionByName(nameless(every))
        rows = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(with_features(both, dictionary)).select(
            "_x", F.col("label").cast("double").alias("label"), "weight"
        )
        rows = rows.sort("label", F.hash(vector_to_array("_x"))).coalesce(1)  # twice max_train rows, in one order whatever the layout
        forest = RandomForestClassifier(
            featuresCol="_x", labelCol="label", weightCol="weight", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y", numTrees=TREES, maxDepth=DEPTH, seed=seed
        )
        if rows.select("label").distinct().count() < 2:
            return Forest([], None, secret / total)
        return Forest(dictionary, forest.fit(rows), secret / total)
    finally:
        sample.unpersist()


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD, path_col: str = "source") -> DataFrame:
    """doc_id, word, length, value_sha256, score, is_secret: one row a candidate in ``docs``.

    Without a forest one is trained from the table's own certain findings.
    """
    found = candidates(docs, path_col)
    forest = forest or train(labelled_by_rule(found))
    return forest.score(found).select(
        "doc_id",
        "word",
        F.length("value").cast("long").alias("length"),
        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"),
        "score",
        (F.col("score") >= threshold).alias("is_secret"),
    )
