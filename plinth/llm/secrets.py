"""Secret scan: candidates by shape, a random forest against false positives.

Candidates are long runs of key-like characters in whole texts, and shorter values
that are assigned to a word such as password.  Each has features of its length, its
character transitions, the share of it that corpus words cover (the dictionary: the
``DICTIONARY`` most frequent words, counted over all texts), path-like surroundings
and the neighbouring words.

Labelled findings come from callers.  Where nobody has labelled any, ``shape_labels``
takes them from evidence that the forest doesn't see: published formats of keys
(prefix, alphabet and exact length) are secrets; numbers with a right check digit,
mail hosts, identifiers in addresses, UUIDs, versions, encoded plain text, parts of
longer words and words that end a clause are none.  What neither holds for is left
to the forest.

The trees are grown by Spark on at most ``MAX_TRAIN`` labelled findings: half of
each class (the least hashes), a rarer class whole, both of the same weight, so
that a rare class counts in every split however many findings there are.  What a
leaf says is then counted over all labelled findings: the share of class 1 in it.
A candidate's probability is the mean of its leaves; the secret itself is never
returned, only its place, length and hash.

Defined results: null or blank texts have no findings, and an empty table has none.
Places are in characters of the text.  Repeated rows give repeated findings.  Ids keep
their type and may be null.  With labels of one class only the probability is that
label; without labels it is 0.5.  Only the id and the text of a table are read, so
further columns never clash.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import class_shares

MAX_TRAIN, DICTIONARY, LEAST, LEAST_ASSIGNED, NEAR = 20_000, 3000, 16, 6, 40
_WORDISH = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Words beside a value that name it a secret.
SECRET_WORDS = ("token", "secret", "password", "passwd", "api_key", "apikey", "key", "credential", "bearer", "authorization")
_RUN = re.compile(r"[A-Za-z0-9+/_.\-]{%d,}={0,2}" % LEAST)
_ASSIGNED = re.compile(r"(?<![A-Za-z])(?:%s)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>(){}\[\],;:=]{%d,}={0,2})" % ("|".join(SECRET_WORDS), LEAST_ASSIGNED), re.IGNORECASE)
FEATURES = (
    "log length", "entropy", "class changes", "letter-digit changes", "digits", "capitals", "longest letters", "dictionary", "slashes", "dots",
    "path before", "extension", "assigned", "quoted", "secret word before", "secret word near",
)
_CLASS = str.maketrans({**dict.fromkeys("abcdefghijklmnopqrstuvwxyz", "a"), **dict.fromkeys("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A"), **dict.fromkeys("0123456789", "9"), **dict.fromkeys("+/_=.-", "-")})
#: Published formats of keys and tokens (fixed values).
KEY_SHAPES = {
    "cloud access key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "code host token": r"gh[pousr]_[A-Za-z0-9]{36}",
    "40 digit token": r"[0-9a-f]{40}",
    "chat token": r"xox[abprs]-[A-Za-z0-9\-]{10,}",
    "maps key": r"AIza[A-Za-z0-9_\-]{35}",
    "payment key": r"[rs]k_live_[A-Za-z0-9]{24,}",
    "web token": r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+",
}
#: Published formats of what is no secret (fixed values).
OTHER_SHAPES = {"uuid": r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", "version": r"v?\d+(?:\.\d+){2,}[A-Za-z0-9.\-]*"}
_KEYS = {name: re.compile(shape) for name, shape in KEY_SHAPES.items()}
_OTHERS = {name: re.compile(shape) for name, shape in OTHER_SHAPES.items()}


def dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> list[str]:
    """The most frequent words of three letters or more over all texts, ``size`` at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["w", "n"])
            seen.clear()
            return batch

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                seen.update((t or b"").translate(_WORDISH).split())
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    words = docs.select(F.col(text).cast("string")).mapInArrow(count, "w string, n long").where(F.length("w") >= 3).groupBy("w").agg(F.sum("n").alias("n"))
    return [r["w"] for r in words.orderBy(F.desc("n"), "w").limit(size).collect()]


def covered_share(value: str, words: frozenset[str], longest: int) -> float:
    """Share of a value that dictionary words cover, taken greedily from the left."""
    value, at, hit = value.lower(), 0, 0
    while at < len(value):
        for size in range(min(longest, len(value) - at), 2, -1):
            if value[at : at + size] in words:
                hit, at = hit + size, at + size
                break
        else:
            at += 1
    return hit / max(1, len(value))


def places(text: str) -> list[tuple[int, int]]:
    """Begin and end of the candidates of a text, in order and apart."""
    found = [m.span(1) for m in _ASSIGNED.finditer(text)]
    taken = iter(sorted(found))
    now = next(taken, None)
    for m in _RUN.finditer(text):
        begin, end = m.span()
        while text[begin] in "+/_.-" and end - begin >= LEAST:
            begin += 1
        while text[end - 1] in ".-" and end - begin >= LEAST:
            end -= 1
        while now is not None and now[1] <= begin:
            now = next(taken, None)
        if end - begin >= LEAST and (now is None or now[0] >= end):
            found.append((begin, end))
    return sorted(found)


def describe(text: str, begin: int, end: int, words: frozenset[str], longest: int) -> list[float]:
    value, before, after = text[begin:end], text[max(0, begin - NEAR) : begin], text[end : end + 1]
    n, kinds = len(value), value.translate(_CLASS)
    near = before.lower()
    left = re.findall(r"[a-z_]+", near)
    counts = Counter(value)
    return [
        math.log(n),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        sum({a, b} in ({"a", "9"}, {"A", "9"}) for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        kinds.count("9") / n,
        kinds.count("A") / n,
        max(map(len, re.findall(r"[aA]+", kinds)), default=0) / n,
        covered_share(value, words, longest),
        value.count("/") / n,
        value.count(".") / n,
        float(bool(re.search(r"(://|/|\\|\bfile|\bpath)[^\s]*$", near))),
        float(bool(re.search(r"\.[a-z]{2,4}$", value))),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(before[-1:] in ("'", '"') and after == before[-1:]),
        float(bool(left) and left[-1] in SECRET_WORDS),
        float(any(w in SECRET_WORDS for w in left)),
    ]


def check_digit(digits: str) -> bool:
    """Whether the last digit is that of the Luhn rule."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _plain_text_inside(value: str) -> bool:
    if len(value) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", value):
        return False
    try:
        raw = base64.b64decode(value, validate=True)
    except binascii.Error:
        return False
    return sum(c in (9, 10, 13) or 32 <= c < 127 for c in raw) == len(raw)


def evidence(text: str, begin: int, end: int) -> str | None:
    """What the candidate certainly is, by a published format or by its place; none of it is a feature."""
    value, before, after = text[begin:end], text[begin - 1 : begin] if begin else "", text[end : end + 2]
    word = re.search(r"\S*\Z", text[max(0, begin - 400) : begin]).group()
    if "://" in word:
        return "in an address"
    if before == "@":
        return "mail host"
    for name, shape in _OTHERS.items():
        if shape.fullmatch(value):
            return name
    for name, shape in _KEYS.items():
        if shape.fullmatch(value) and not (before.isalnum() or after[:1].isalnum()):
            return name
    if value.isdigit():
        return "check digit" if 13 <= len(value) <= 19 and check_digit(value) else None
    if value.isalpha():
        if (before.isalpha() and not before.isascii()) or (after[:1].isalpha() and not after[:1].isascii()):
            return "part of a word"
        return "ends a clause" if re.match(r"[.,;:!?](\s|\Z)", after) else None
    return "encoded text" if _plain_text_inside(value) else None


def candidates(docs: DataFrame, words: list[str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, begin, length, sha256, features and evidence (a name or null) of every candidate in every text."""
    shared = docs.sparkSession.sparkContext.broadcast((frozenset(words), max(map(len, words), default=0)))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, begins, lengths, hashes, features, known = [], [], [], [], [], []
            for row, t in enumerate(batch.column(1).to_pylist()):
                for begin, end in places(t or ""):
                    rows.append(row)
                    begins.append(begin)
                    lengths.append(end - begin)
                    hashes.append(hashlib.sha256(t[begin:end].encode()).hexdigest())
                    features.append(describe(t, begin, end, *shared.value))
                    known.append(evidence(t, begin, end))
            own = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([own, pa.array(begins, pa.int64()), pa.array(lengths, pa.int64()), pa.array(hashes, pa.string()), pa.array(features, pa.list_(pa.float64())), pa.array(known, pa.string())], ["doc_id", "begin", "length", "sha256", "features", "evidence"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(find, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, begin long, length long, sha256 string, features array<double>, evidence string")


def shape_labels(found: DataFrame) -> DataFrame:
    """``found`` with label: 1 for formats of keys, 0 for other evidence, null without any."""
    return found.withColumn("label", F.when(F.col("evidence").isin(*KEY_SHAPES), 1).when(F.col("evidence").isNotNull(), 0))


def remove_false_positives(found: DataFrame, labelled: DataFrame, trees: int = 20, depth: int = 6, max_train: int = MAX_TRAIN) -> DataFrame:
    """``found`` with probability (that it is a secret); ``labelled``: features and label (0, 1 or null)."""
    rows = labelled.where(F.col("label").isin(0, 1)).select("features", F.col("label").cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        return found.withColumn("probability", F.lit(float(next(iter(counts), 0.5))))
    take = class_shares(counts, max_train)
    few = [rows.where(F.col("label") == c).orderBy(F.xxhash64("features"), "features").limit(n).withColumn("weight", F.lit(max_train / 2 / n)) for c, n in take.items()]
    sample = few[0].unionByName(few[1]).select(array_to_vector("features").alias("x"), F.col("label").cast("double").alias("label"), "weight").persist()
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", weightCol="weight", leafCol="leaves", numTrees=trees, maxDepth=depth, seed=11)
    model = forest.fit(sample)
    sample.unpersist()
    leaves = lambda df: model.transform(df.withColumn("x", array_to_vector("features"))).withColumn("leaves", vector_to_array("leaves"))
    placed = leaves(rows.withColumnRenamed("label", "own")).select("own", F.posexplode("leaves").alias("tree", "leaf"))
    shares = [{} for _ in range(trees)]
    for tree, leaf, share in placed.groupBy("tree", "leaf").agg(F.avg("own")).collect():  # at most trees x 2^depth
        shares[tree][leaf] = share
    # Each leaf holds findings of the sample, so none is without a share.
    table = F.array(*[F.create_map(*[F.lit(v) for pair in each.items() for v in pair]) for each in shares])
    own = F.transform("leaves", lambda leaf, tree: F.try_element_at(F.get(table, tree), leaf))
    mean = F.aggregate(own, F.lit(0.0), lambda total, share: total + share) / trees
    return leaves(found).withColumn("probability", mean).drop("x", "rawPrediction", "prediction", "leaves")
