"""Secret scans: candidate strings, and a random forest that removes false positives.

A candidate is a maximal run of at least `least_length` characters that keys, tokens and encoded data
are made of, with up to two padding signs; or, behind a credential name and an assignment sign, any
text of at least `least_assigned` characters up to a blank, a quote or a separator. The forest looks at
its length, its character transitions, how much of it the corpus's words cover, the path of the
document, and the neighbouring text.

What is learnt from the documents (all of them): the probability of each letter after another, from
the counts of all words, and the `dictionary` most frequent words. The forest is trained on labelled
findings. Where no table of them is given, findings are made whose labels are known by construction:
keys, tokens and passwords are planted, with names before them and without; hashes, identifiers,
digests, versions, addresses, file names and plain words are planted too, with credential names before
them and without. No rule over the features has a part in a label. The trained trees become one SQL
expression, so a scan is row-local DataFrame work: candidates and the text between them are two arrays
of one row. The neighbouring text is that of the whole document: a long credential name is itself a
candidate and still stands before its value.

Defined results: null and empty texts have no candidates; a text that is one long run is one
candidate; repeated rows are scanned alike and candidates that occur twice are two findings; a null
path is an unknown path; an empty table gives an empty result (the made findings still train a
forest, and every letter follows every other alike); other columns are ignored, and `redact` returns
them unchanged.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsloom.llm.common import written
from newsloom.settings import discard

# Characters of a candidate, heads of known key formats, credential names, signs of a stand-in, signs of a path without real keys, characters of an assigned value.
RUN = r"A-Za-z0-9+/_.\-"
HEADS = "AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xox[abprs]-|eyJ"
NAMES = "token|secret|passw|passwd|pwd|api.?key|access.?key|private.?key|auth|bearer|credential|signature"
STAND_INS = "example|sample|dummy|placeholder|changeme|your.?|xxxx|test"
TAME_PATHS = "test|example|sample|doc|spec|fixture|mock"
ASSIGNED = r"[^\s\"'`,;<>()\[\]{}]"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Stands between a text and its candidates while both are one string.
CUT = "\ue0f7"


@dataclass(frozen=True)
class ScanOptions:
    """`sample_findings` bounds what the forest is trained on, `dictionary` the words it knows."""

    least_length: int = 16
    least_assigned: int = 6
    before: int = 40
    after: int = 20
    trees: int = 12
    depth: int = 6
    dictionary: int = 2000
    sample_findings: int = 20_000
    generated: int = 12_000
    threshold: float = 0.5
    seed: int = 5


@dataclass(frozen=True)
class Language:
    """The most frequent words, and the logarithm of the probability of each letter after another (row: first letter)."""

    words: tuple[str, ...]
    transitions: tuple[float, ...]


@dataclass(frozen=True)
class Forest:
    """Trees as nested tuples: (feature, threshold, left, right) or a leaf's probability."""

    options: ScanOptions
    trees: tuple
    language: Language


def learn_language(docs: DataFrame, options: ScanOptions = ScanOptions()) -> Language:
    """From the words of all documents, whole texts: runs of letters a-z in any case.

    Words are counted before the shuffle; letter pairs come from the distinct words, weighted by
    their counts. The driver gets `dictionary` words and at most 676 pairs.
    """
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit("[a-z]{3,24}"), F.lit(0))).alias("word"))
    counts = written(words.groupBy("word").agg(F.count("*").alias("n")), "word-counts")
    top = [r["word"] for r in counts.where(F.length("word") >= 4).orderBy(F.desc("n"), "word").limit(options.dictionary).collect()]
    places = F.sequence(F.lit(1), F.length("word") - 1)
    pairs = counts.select("n", F.explode(F.transform(places, lambda i: F.substr(F.col("word"), i, F.lit(2)))).alias("pair"))
    found = {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    discard(counts)
    rows = []
    for a in LETTERS:
        row = [found.get(a + b, 0) + 1.0 for b in LETTERS]
        rows += [math.log(v / sum(row)) for v in row]
    return Language(tuple(top), tuple(rows))


def _pattern(options: ScanOptions) -> str:
    # An assigned value is looked for only where a sign of assignment stands before; the name is checked there.
    named = rf"(?<=(?i:{NAMES})[\"'`\w]{{0,12}}\s{{0,3}}(?:=|:|:=|=>)\s{{0,3}}[\"'`]?)"
    # One character before tells at most places of a text that none does.
    assigned = rf"(?<=[:=>\s\"'`])(?<=[:=>]\s{{0,3}}[\"'`]?){named}{ASSIGNED}{{{options.least_assigned},200}}"
    return f"{assigned}|(?<![{RUN}])[{RUN}]{{{options.least_length},}}+={{0,2}}"


def constant(values, kind: str) -> Column:
    """Many values as one literal of the plan, whatever their number."""
    return F.from_json(F.lit(json.dumps(list(values))), kind)


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(pattern).cast("double")


def features(value: Column, before: Column, after: Column, path: Column, language: Language) -> list[Column]:
    """The forest's inputs, in order."""
    length = F.length(value).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / length
    low = F.lower(value)
    table = constant(language.transitions, "array<double>")
    # Overlapping pairs of letters in one pass, however long the value.
    pairs = F.regexp_extract_all(low, F.lit("(?=([a-z]{2}))"), F.lit(1))
    at = lambda p: ((F.ascii(p) - 97) * 26 + F.ascii(F.right(p, F.lit(1))) - 97).cast("int")
    sums = F.aggregate(pairs, F.lit(0.0), lambda total, p: total + F.coalesce(F.get(table, at(p)), F.lit(0.0)))
    likely = F.when(F.size(pairs) > 0, sums / F.size(pairs)).otherwise(-6.0)
    spelled = F.regexp_extract_all(F.lower(F.regexp_replace(value, "(?<=[a-z])(?=[A-Z])", " ")), F.lit("[a-z]{4,}"), F.lit(0))
    known = F.filter(spelled, lambda w: F.array_contains(constant(language.words, "array<string>"), w))
    letters = lambda words: F.aggregate(words, F.lit(0.0), lambda total, w: total + F.length(w))
    return [
        F.least(length, F.lit(200.0)),
        share("[0-9]"),
        share("[A-Z]"),
        share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"),
        share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        likely,
        F.size(pairs) / length,
        share("[+/_=.\\-]"),
        share("[^A-Za-z0-9+/_=.\\-]"),
        F.regexp_count(value, F.lit("\\.")).cast("double"),
        F.regexp_count(value, F.lit("/")).cast("double"),
        letters(spelled) / length,
        letters(known) / length,
        _has(value, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        _has(value, "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"),
        _has(F.right(before, F.lit(24)), f"(?i)(?:{NAMES})"),
        _has(before, f"(?i)(?:{NAMES})[\"'`\\w]{{0,12}}\\s*(?:[:=]|:=|=>)\\s*[\"'`]?$"),
        _has(before, "[:=]\\s*[\"'`]?$"),
        _has(before, "[\"'`]$"),
        _has(F.right(before, F.lit(24)), "(?i)(?:hash|sha|md5|digest|checksum|commit|rev|uuid|guid|version|_id|count|url|path|file|name|type|expir|length|algo)[\"'`\\w]{0,12}\\s*(?:[:=]|:=|=>|\\s)\\s*[\"'`]?$"),
        _has(before, "@$") + _has(after, "^@"),
        _has(F.concat(before, value, after), f"(?i)(?:{STAND_INS})"),
        F.coalesce(_has(path, f"(?i)(?:{TAME_PATHS})"), F.lit(0.5)),
        _has(value, f"^(?:{HEADS})"),
        _has(value, "^[A-Z0-9]+$"),
        _has(value, "^(?:https?:|[a-z]+://|www\\.|[./~])"),
    ]


def _pieces(text: Column, options: ScanOptions) -> Column:
    """The text cut at its candidates: text, candidate, text and so on, one text more than candidates. One pass of the pattern."""
    whole, pattern = F.coalesce(text, F.lit("")), F.lit(_pattern(options))
    marked = F.split(F.regexp_replace(whole, pattern, F.lit(f"{CUT}$0{CUT}")), CUT, -1)
    # A text that holds the sign itself takes two passes.
    found, between = F.regexp_extract_all(whole, pattern, F.lit(0)), F.split(whole, _pattern(options), -1)
    paired = F.flatten(F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, v: F.array(b, v)))
    return F.when(F.contains(whole, F.lit(CUT)), F.concat(paired, F.array(F.element_at(between, -1)))).otherwise(marked)


def _items(pieces: Column) -> tuple[Column, Column]:
    """The candidates, and the texts around them (one more than candidates)."""
    return F.filter(pieces, lambda _, i: i % 2 == 1), F.filter(pieces, lambda _, i: i % 2 == 0)


def _in_context(found: Column, between: Column, options: ScanOptions) -> Column:
    """value, before, after of each candidate: the text around it, other candidates included.

    Put together from as many neighbouring pieces as the widths can reach, so the work grows with the text.
    """
    smallest = min(options.least_length, options.least_assigned + 4)  # of a candidate with the text before it
    reach = lambda width: range(1, -(-width // smallest) + 1)

    def item(value: Column, i: Column) -> Column:
        left = [p for j in reversed(reach(options.before)) for p in (F.get(between, i - j), F.get(found, i - j))] + [F.get(between, i)]
        right = [F.get(between, i + 1)] + [p for j in reach(options.after) for p in (F.get(found, i + j), F.get(between, i + j + 1))]
        ends = [F.coalesce(F.right(p, F.lit(options.before)), F.lit("")) for p in left]
        starts = [F.coalesce(F.left(p, F.lit(options.after)), F.lit("")) for p in right]
        return F.struct(value.alias("value"), F.right(F.concat(*ends), F.lit(options.before)).alias("before"), F.left(F.concat(*starts), F.lit(options.after)).alias("after"))

    return F.transform(found, item)


def candidates(docs: DataFrame, options: ScanOptions = ScanOptions(), path_col: str = "source") -> DataFrame:
    """doc_id, path, start (characters before it), value, before, after: one row per candidate."""
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    found, between = _items(F.col("pieces"))
    # Texts without candidates give no rows below; a filter here would find the candidates once more.
    cut = docs.select("doc_id", path.alias("path"), _pieces(F.col("text").cast("string"), options).alias("pieces"))
    cut = cut.select("doc_id", "path", found.alias("found"), between.alias("between"))
    lengths = F.zip_with("found", "between", lambda v, b: F.length(v) + F.length(b))
    # Ends of the candidates so far; each starts its own length before its end.
    ends = F.aggregate(lengths, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.element_at(out, -1) + n)))
    cut = cut.withColumn("ends", ends)
    item = lambda c, i: F.struct((F.get("ends", i + 1) - F.length(c["value"])).alias("start"), c["value"].alias("value"), c["before"].alias("before"), c["after"].alias("after"))
    return cut.select("doc_id", "path", F.inline(F.transform(_in_context(F.col("found"), F.col("between"), options), item)))


def rule_label(value: Column, before: Column) -> Column:
    """A plain rule to measure the forest against: a credential name or a known head, letters and digits."""
    named = before.rlike(f"(?i)(?:{NAMES})[\"'`\\w]{{0,12}}\\s*(?:[:=]|:=|=>)\\s*[\"'`]?$")
    return ((named | value.rlike(f"^(?:{HEADS})")) & value.rlike("[0-9]") & value.rlike("[A-Za-z]")).cast("double")


def made_findings(spark: SparkSession, language: Language, options: ScanOptions, first: int = 0) -> DataFrame:
    """value, before, after, path, label: what is planted is known, so its label is, whatever stands before it.

    Findings are numbered; other numbers (from `first` on) are other findings."""
    n = F.col("id")
    words = language.words or ("plain", "words", "without", "corpus")

    def pick(values, salt: int) -> Column:
        return F.element_at(constant(values, "array<string>"), (F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(len(values))) + 1).cast("int"))

    def chance(salt: int, of: int) -> Column:
        return F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(of))

    hexes = F.sha2(F.concat(F.lit("finding"), n.cast("string")), 256)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat(F.lit("mixed"), n.cast("string")), 512))), "=+$", "")
    plain = F.regexp_replace(mixed, "[+/]", "x")
    near_words = words[:200]
    word = lambda i: pick(near_words, i)
    cut = (chance(3, 24) + 20).cast("int")
    signs = ["!", "@", "#", "$", "%", "^", "&", "*", "?"]
    year = F.concat(F.lit("20"), (chance(60, 20) + 10).cast("string"))
    uuid = F.concat_ws("-", F.left(hexes, F.lit(8)), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4), F.substring(hexes, 17, 4), F.substring(hexes, 21, 12))
    secrets = [
        F.left(plain, cut),
        F.left(mixed, F.lit(40)),
        F.left(hexes, F.when(chance(41, 2) == 0, 32).otherwise(40)),
        F.concat(F.lit("AKIA"), F.left(F.upper(plain), F.lit(16))),
        F.concat(pick(["ghp_", "sk_live_", "glpat-", "xoxb-", "AIza", "sk-"], 4), F.left(plain, cut)),
        F.concat(F.lit("eyJ"), F.left(mixed, F.lit(20)), F.lit("."), F.substring(mixed, 21, 30), F.lit("."), F.substring(mixed, 51, 30)),
        F.concat(pick(words[:400], 30), year),
        F.concat(F.initcap(pick(words[:400], 31)), pick(signs, 32), (chance(33, 900) + 10).cast("string")),
        F.concat(F.left(plain, F.lit(6)), pick(signs, 34), F.substring(plain, 8, 5), pick(signs, 35), F.substring(plain, 14, 6)),
    ]
    tame = [
        F.left(hexes, F.lit(40)),
        hexes,
        F.md5(n.cast("string")),
        uuid,
        F.concat_ws(".", chance(50, 30).cast("string"), chance(51, 30).cast("string"), chance(52, 99).cast("string"), F.lit("post20240101")),
        F.concat(F.lit("20240"), n.cast("string"), F.lit("000000000000")),
        F.concat(word(5), F.lit("."), word(6), F.lit("@"), word(7), F.lit(".example.org")),
        F.concat(F.lit("https://"), word(8), F.lit(".org/"), word(9), F.lit("/"), word(10), F.lit("?id="), chance(53, 9999).cast("string")),
        F.concat(word(11), F.lit("/"), word(12), F.lit("/"), word(13), F.lit("-"), word(14), F.lit(".html")),
        F.concat(word(15), F.lit("_"), word(16), F.lit("_"), word(17), F.lit("_"), word(18)),
        F.concat(*[F.initcap(word(i)) for i in range(19, 24)]),
        F.upper(F.concat_ws("_", word(24), word(25), word(26))),
        F.concat(F.lit("${"), F.upper(word(27)), F.lit("_"), F.upper(word(28)), F.lit("}")),
        F.concat(word(29), word(36), word(46)),
        F.initcap(F.concat(word(47), word(48), word(49), word(59))),
        F.initcap(F.concat(word(61), word(62), word(63), word(64), word(65))),
        F.concat(F.initcap(F.concat(word(66), word(67), word(68), word(69))), F.lit(".")),
        F.lpad((F.pmod(F.xxhash64(n, F.lit(70)), F.lit(10_000_000_000_000_000))).cast("string"), 16, "4"),
        F.repeat(pick(["-", "_", "=", ".", "ab", "x"], 37), 20),
        F.concat(pick(["mail", "smtp", "host", "mx", "news"], 71), chance(72, 40).cast("string"), F.lit("."), pick(["example.com", "example.org", "test.net"], 73)),
        F.concat(word(74), F.lit("."), word(75), chance(76, 90).cast("string"), pick([".org", ".com", ".net", ".de"], 77)),
    ]
    kind = F.pmod(F.shiftright(n, 1), F.lit(len(secrets) * len(tame))).cast("int")
    secret = (n % 2 == 0).cast("double")
    names = ["token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret", "credential", "aws_secret_access_key", "DB_PASSWORD", "passwd", "private_key"]
    tame_names = ["commit", "sha256", "checksum", "uuid", "version", "file", "url", "path", "id", "name", "digest", "rev", "build", "ref"]
    mixed_names = ["token_type", "secret_name", "auth_url", "password_file", "api_key_id", "token_count", "credential_type", "signature_version", "password_hash", "key_path"]
    sign = pick([' = "', '="', ": ", "=", ": '", ' := "', " => "], 9)
    near = F.concat(word(1), F.lit(" "), word(2), F.lit(" "))
    # Keys of a known or dense form also stand alone; passwords only where a name says what they are.
    index = kind % len(secrets)
    bare_secret = (index <= 5) & (chance(18, 10) < 3)
    before_secret = F.when(bare_secret, near).otherwise(F.concat(near, pick(names, 19), sign))
    place = chance(20, 10)
    before_tame = (
        F.when((kind % len(tame) >= len(tame) - 2) & (place < 7), F.concat(near, word(78), F.lit("."), chance(79, 60).cast("string"), F.lit("@")))
        .when(place < 3, near)
        .when(place < 4, F.concat(near, F.lit(". ")))
        .when(place < 6, F.concat(near, pick(tame_names, 38), sign))
        .when(place < 9, F.concat(near, pick(mixed_names, 39), sign))
        .otherwise(F.concat(near, pick(names, 40), F.lit(" "), word(42), F.lit(" ")))
    )
    before = F.when(n % 2 == 0, before_secret).otherwise(before_tame)
    path = F.when(chance(43, 8) == 0, "docs/guide").otherwise(F.concat(F.lit("src"), chance(44, 20).cast("string")))
    # Step by step: one expression over all kinds would be too large to compile.
    ids = spark.range(first, first + options.generated)
    values = written(ids.where(n % 2 == 0).select("id", F.element_at(F.array(*secrets), kind % len(secrets) + 1).alias("value")), "findings").unionByName(
        written(ids.where(n % 2 == 1).select("id", F.element_at(F.array(*tame), kind % len(tame) + 1).alias("value")), "findings")
    )
    placed = written(values.select("id", "value", F.right(before, F.lit(options.before)).alias("before")), "findings")
    quoted = F.when(F.col("before").rlike("[\"']$"), F.right("before", F.lit(1))).otherwise("")
    rows = placed.select("value", "before", F.concat(quoted, F.lit(" "), word(45)).alias("after"), path.alias("path"), secret.alias("label"))
    return rows.where(F.length("value") >= options.least_assigned)


def train(findings: DataFrame, language: Language, options: ScanOptions = ScanOptions()) -> Forest:
    """findings: value, before, after, path, label (0 or 1). At most `sample_findings` rows, chosen by hash, are used."""
    made = features(F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), F.col("path"), language)
    columns = [f"f{i}" for i in range(len(made))]
    sample = findings.where(F.col("value").isNotNull() & (F.length("value") > 0) & F.col("label").isNotNull()).orderBy(F.xxhash64("value", "before", "after"), "label").limit(options.sample_findings)
    # Training passes over its rows many times: they are computed once. One file has one order, so that training repeats exactly.
    sample = written(sample.select("value", "before", "after", "path", "label"), "findings")
    rows = written(sample.orderBy(F.xxhash64("value", "before", "after"), "label").select(*[c.alias(n) for c, n in zip(made, columns)], "label").coalesce(1), "findings")
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=options.trees, maxDepth=options.depth, seed=options.seed, featureSubsetStrategy="sqrt").fit(rows)

    def plain(node):
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return stats[1] / sum(stats) if len(stats) > 1 and sum(stats) else 0.0
        split = node.split()
        return split.featureIndex(), split.threshold(), plain(node.leftChild()), plain(node.rightChild())

    return Forest(options, tuple(plain(tree._java_obj.rootNode()) for tree in model.trees), language)


def trained_on(docs: DataFrame, options: ScanOptions = ScanOptions()) -> Forest:
    """A forest with the language of the documents, trained on made findings."""
    language = learn_language(docs, options)
    return train(made_findings(docs.sparkSession, language, options), language, options)


def forest_score(forest: Forest, inputs: list[Column]) -> Column:
    """Mean of the trees' probabilities, as an expression over the features."""

    def expression(node) -> Column:
        if not isinstance(node, tuple):
            return F.lit(float(node))
        feature, threshold, low, high = node
        return F.when(inputs[feature] <= F.lit(float(threshold)), expression(low)).otherwise(expression(high))

    total = expression(forest.trees[0])
    for tree in forest.trees[1:]:
        total = total + expression(tree)
    return total / F.lit(float(len(forest.trees)))


def _scored(found: DataFrame, forest: Forest) -> DataFrame:
    made = features(F.col("value"), F.col("before"), F.col("after"), F.col("path"), forest.language)
    columns = [f"_f{i}" for i in range(len(made))]
    # Features are bound once as columns; the trees then only compare numbers.
    bound = found.withColumns(dict(zip(columns, made)))
    return bound.withColumn("score", forest_score(forest, [F.col(c) for c in columns])).drop(*columns)


def scan(docs: DataFrame, forest: Forest, path_col: str = "source") -> DataFrame:
    """doc_id, path, start, value, before, after, score, is_secret: every candidate with the forest's verdict."""
    scored = _scored(candidates(docs, forest.options, path_col), forest)
    return scored.withColumn("is_secret", (F.col("score") >= forest.options.threshold).cast("int"))


def redact(docs: DataFrame, forest: Forest, path_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """The documents with their own columns; secrets in `text` become the mark. Row-local, no shuffle."""
    options, names = forest.options, docs.columns
    found, between = _items(F.col("_pieces"))
    path = F.col(path_col).cast("string") if path_col in names else F.lit(None).cast("string")
    held = docs.select(*names, _pieces(F.col("text").cast("string"), options).alias("_pieces"), path.alias("_path"))
    held = held.select(*names, found.alias("_found"), between.alias("_between"), "_path")

    def replaced(item: Column) -> Column:
        value = item["value"]
        made = features(value, item["before"], item["after"], F.col("_path"), forest.language)
        # A one-element transform binds the features, so that each is computed once per candidate.
        score = F.get(F.transform(F.array(F.array(*made)), lambda f: forest_score(forest, [F.get(f, k) for k in range(len(made))])), 0)
        return F.when(score >= options.threshold, F.lit(mark)).otherwise(value)

    kept = F.concat(F.array_join(F.zip_with(F.transform(_in_context(F.col("_found"), F.col("_between"), options), replaced), F.slice("_between", F.lit(1), F.size("_found")), lambda v, b: F.concat(b, v)), ""), F.element_at("_between", -1))
    text = F.when(F.size("_found") > 0, kept).otherwise(F.col("text").cast("string"))
    return held.withColumn("_text", text).select(*[F.col("_text").alias("text") if n == "text" else F.col(n) for n in names])
