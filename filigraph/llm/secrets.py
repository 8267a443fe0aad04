"""Secret scans with a random forest for false-positive removal.

A wide pattern finds candidates; a forest trained from labelled findings decides by length,
character transitions, dictionary coverage, path and neighbouring words. Everything runs as
DataFrame expressions and the DataFrame-based machine learning library, without Python workers.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filigraph.llm.shared import cut, text_or_empty

#: A private key from its first line to its last (the first line alone where no last one follows), a run of 16 or more characters that keys are written in with its
#: padding, or a shorter value (6 characters or more) that something called a password, secret, token or key is set to: in quotes any signs up to the closing
#: one, else up to a blank, a quote, a comma, a semicolon or a bracket. No candidate has a greatest length.
HEAD = r"-----BEGIN (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END (?:[A-Z]{2,9} ){0,2}PRIVATE KEY-----)?+"
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}+(?![A-Za-z0-9])"
_NAMED = r"(?:[Pp]assword|PASSWORD|[Pp]asswd|PASSWD|[Pp]wd|PWD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Kk]ey|KEY)[\"']? {0,2}[=:] {0,2}"
QUOTED = "|".join(rf"(?<={q})(?<=[=:] {{0,2}}{q})(?<={_NAMED}{q})[^\s{q}]{{6,}}+(?={q})" for q in "\"'")
SET_TO = rf"(?<=[=:\"' ])(?<=[=:] {{0,2}}[\"']?)(?<={_NAMED}[\"']?)(?![=:\"'\s])[^\s\"'<>,;(){{}}\[\]]{{6,}}+"
CANDIDATE = f"{HEAD}|{QUOTED}|{RUN}|{SET_TO}"
#: A text around a candidate of 6 characters or more spans at most so many others before it and after it.
_BEFORE, _AFTER, _BACK, _ON = 48, 24, 7, 4
#: Words that a made-up key or a plain identifier is built from.
DICTIONARY = (
    "access account address admin api app archive array auth base block build cache case center change character check class client code "
    "column common config content context control copy count create data date default delete demo detail document dummy email entry error "
    "event example file final first format from function handler hash have here http id image index info insert item key language last "
    "library line list local log main make manager message method mode model module name network new node number object option order page "
    "param pass password path placeholder point process project public read record report request response result row sample script "
    "search secret section server service session set size source start state status string super system table task test text the this "
    "time title token type update url user value version view window word work xxxx your"
).split()
KEYWORDS = r"(?i)(token|secret|passw|pwd|api.?key|apikey|auth|credential|private|access.?key|signing)[a-z_ ]{0,12}[\"']?\s{0,2}[=:]{1,2}\s{0,2}[\"']?$"
WEAK_KEYWORDS = r"(?i)(token|secret|passw|pwd|key|auth|credential|private)"
BENIGN = r"(?i)(commit|checksum|sha-?\d|md5|digest|etag|uuid|guid|revision|fingerprint|integrity|order|invoice|isbn|example|sample|dummy|placeholder)"
PREFIXES = r"^(AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ|glpat-)"
SIDE_PATHS = r"(?i)(test|example|fixture|sample|doc|mock|vendor|readme)"
SETTING_PATHS = r"(?i)(\.env|config|settings|credential|secret|deploy|\.(ya?ml|toml|ini|properties|pem|tfvars)$)"


#: At most so many of a corpus's own words join the dictionary.
CORPUS_WORDS = 2000


def frequent_words(docs: DataFrame, most: int = CORPUS_WORDS, text_col: str = "text") -> list[str]:
    """The ``most`` words of 4 to 12 letters a-z that the most documents have, by all whole texts."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(text_col)), F.lit(r"\b[a-z]{4,12}\b"), F.lit(0)))).alias("word")
    counts = docs.select(words).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r["word"] for r in counts.where("n > 1").orderBy(F.desc("n"), "word").limit(most).collect()]


def _any_of(words: Iterable[str]) -> str:
    """A pattern of the longest of some words at a place: alternatives share their beginnings, so a place is left after a few letters."""
    by_letter: dict[str, set[str]] = {}
    for word in words:
        by_letter.setdefault(word[:1], set()).add(word[1:])
    ends = "?" if by_letter.pop("", None) else ""
    inner = "|".join(c + (_any_of(rest) if rest != {""} else "") for c, rest in sorted(by_letter.items()))
    return f"(?:{inner}){ends}" if inner else ""


def _share(pattern: str) -> Column:
    return (F.col("length") - F.length(F.regexp_replace("candidate", pattern, ""))) / F.col("length")


def _transitions(before: str, after: str) -> Column:
    """How often a character of one class is followed by one of another, per character."""
    marked = F.regexp_replace("candidate", f"(?<=[{before}])(?=[{after}])", "\u0001")
    return (F.length(marked) - F.col("length")) / F.col("length")


def _flag(column: str, pattern: str) -> Column:
    return F.col(column).rlike(pattern).cast("double")


def features(findings: DataFrame, words: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """Adds the forest's inputs to ``candidate, before, after, path``; returns their names as well. ``words`` join the dictionary."""
    found = {
        "f_digits": _share("[0-9]"),
        "f_upper": _share("[A-Z]"),
        "f_lower": _share("[a-z]"),
        "f_symbols": _share("[^A-Za-z0-9]"),
        "f_hex": _flag("candidate", "^[0-9a-f]+$|^[0-9A-F]+$"),
        "f_only_digits": _flag("candidate", "^[0-9_-]+$"),
        "f_letter_digit": _transitions("A-Za-z", "0-9"),
        "f_digit_letter": _transitions("0-9", "A-Za-z"),
        "f_lower_upper": _transitions("a-z", "A-Z"),
        "f_upper_lower": _transitions("A-Z", "a-z"),
        "f_vowel_turns": _transitions("aeiouAEIOU", "bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ"),
        "f_distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.least(F.col("length"), F.lit(36)),
        "f_dictionary": _share("(?i)" + _any_of({*DICTIONARY, *words})),
        "f_uuid": _flag("candidate", "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"),
        "f_prefix": _flag("candidate", PREFIXES),
        "f_keyword": _flag("before", KEYWORDS),
        "f_weak_keyword": _flag("before", WEAK_KEYWORDS),
        "f_benign": (F.col("before").rlike(BENIGN) | F.col("after").rlike(BENIGN)).cast("double"),
        "f_assigned": _flag("before", r"[=:]\s{0,2}[\"']?$"),
        "f_quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "f_in_path": (F.col("before").rlike("[/.]$") | F.col("candidate").rlike("/.*[a-z]{3,}.*/|^/")).cast("double"),
        "f_side_path": _flag("path", SIDE_PATHS),
        "f_setting_path": _flag("path", SETTING_PATHS),
        "f_no_path": _flag("path", "^$"),
        "f_head": _flag("candidate", "^-----BEGIN"),
        "f_word": _flag("candidate", "^([A-Za-z][a-z]+[-_./]?)+[.!?]?$"),
    }
    return findings.withColumn("length", F.length("candidate").cast("double")).withColumns(found), ["length", *found]


def _running(values: Column, run: int = 256) -> Column:
    """The sums of all values up to each, in time near the number of values: by runs, and within them."""
    fold = lambda xs: F.aggregate(xs, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / run).cast("int")), lambda c: F.slice(values, c * run + 1, F.lit(run)))
    sums = lambda rs: F.transform(rs, lambda r: F.aggregate(r, F.lit(0).cast("bigint"), lambda s, x: s + x))
    with_sums = lambda rs: _let(sums(rs), lambda own: _let(fold(own), lambda ends: F.flatten(F.transform(rs, lambda r, c: F.transform(fold(r), lambda x: x + F.get(ends, c) - F.get(own, c))))))
    return _let(runs, with_sums)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None) -> DataFrame:
    """``doc_id, path, start, candidate, before, after``: every candidate of every whole text, ``start`` from 1.

    The text is split at the candidates, and all is computed where the row is read. ``before`` (48 characters) and ``after`` (24) are of
    the whole text: with 6 characters or more a candidate and one between them, seven earlier and four later ones reach far enough.
    A null or empty text, or one without candidates, gives no rows; a null path is empty.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), path.alias("path"), text_or_empty(text_col).alias("text"))
    rows = rows.select("doc_id", "path", "text", F.explode(F.array(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))).alias("found")).where(F.size("found") > 0)
    rows = rows.select("doc_id", "path", "found", F.explode(F.array(F.split("text", CANDIDATE, -1))).alias("between"))
    ends = _running(F.zip_with(F.slice("between", F.lit(1), F.size("found")), "found", lambda b, f: (F.length(b) + F.length(f)).cast("bigint")))
    rows = rows.select("*", F.explode(F.array(ends)).alias("ends"))
    end_of = lambda c, i: F.right(F.coalesce(F.get(c, i), F.lit("")), F.lit(_BEFORE))
    start_of = lambda c, i: F.left(F.coalesce(F.get(c, i), F.lit("")), F.lit(_AFTER))
    item = lambda i: F.struct(
        (F.get("ends", i) - F.length(F.get("found", i)) + 1).alias("start"),
        F.get("found", i).alias("candidate"),
        F.right(F.concat(*[p for k in range(_BACK, 0, -1) for p in (end_of("found", i - k), end_of("between", i - k + 1))]), F.lit(_BEFORE)).alias("before"),
        F.left(F.concat(*[p for k in range(1, _ON + 1) for p in (start_of("between", i + k), start_of("found", i + k))]), F.lit(_AFTER)).alias("after"),
    )
    places = rows.select("doc_id", "path", F.explode(F.transform(F.sequence(F.lit(0), F.size("found") - 1), item)).alias("item"))
    return places.select("doc_id", "path", "item.*")


def labelled_findings(docs: DataFrame, truth: DataFrame, **columns: str) -> DataFrame:
    """Findings for :func:`train` from reviewed documents: ``truth`` has ``doc_id, start, label`` of candidates; those without a label are left out."""
    return candidates(docs, **columns).join(truth.select("doc_id", "start", F.col("label").cast("double").alias("label")).distinct(), ["doc_id", "start"]).select("candidate", "before", "after", "path", "label")


def synthetic_findings(spark: SparkSession, rows: int = 8000, seed: int = 7) -> DataFrame:
    """Labelled findings ``candidate, before, after, path, label`` of the usual kinds, made from a counter and a hash.

    Labels: random strings in assignments and strings with a provider's prefix are secrets (1);
    digests, identifiers, paths, words, placeholders and numbers are not (0).
    """
    pick = lambda salt, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "id"), F.lit(n))
    word = lambda salt, low, high: F.substring(
        F.translate(F.sha2(F.concat_ws(":", F.lit(f"{seed}{salt}"), "id"), 512), "0123456789abcdef", "aeioutnrshldcmpg"), F.lit(1), F.lit(low) + pick(salt, high - low + 1)
    )
    one_of = lambda salt, *values: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (pick(salt, len(values)) + 1).cast("int"))
    rows_df = spark.range(rows).withColumn("hex", F.sha2(F.concat_ws(":", F.lit(str(seed)), "id"), 512))
    rows_df = rows_df.withColumn("mixed", F.regexp_replace(F.base64(F.unhex("hex")), "[+/=\\s]", "")).withColumn("kind", pick("kind", 20))
    cut_at = lambda column, *sizes: F.substring(column, F.lit(1), F.element_at(F.array(*[F.lit(s) for s in sizes]), (pick("size", len(sizes)) + 1).cast("int")))
    names = ("token", "secret", "password", "api_key", "auth_token", "client_secret", "access_key", "passwd", "AWS_SECRET_ACCESS_KEY", "github_oauth_token", "client_secret_value", "DATABASE_PASSWORD")
    assign = F.concat(one_of("name", *names), one_of("sign", ' = "', "=", ": ", ' = "', '="', ": '"))
    prose = F.concat(word("left1", 2, 9), F.lit(" "), word("left2", 2, 9), F.lit(" "))
    k = F.col("kind")
    candidate = (
        F.when(k <= 1, cut_at("hex", 40, 40, 32, 64, 24))
        .when(k == 2, cut_at("hex", 16, 18, 20, 24))
        .when(k <= 4, cut_at("mixed", 20, 24, 32, 40, 64))
        .when(k == 5, F.concat(one_of("prefix", "AKIA", "ghp_", "sk_live_", "xoxb-"), F.when(pick("prefix", 4) == 0, F.upper(F.substring("hex", 1, 16))).otherwise(F.substring("mixed", 1, 36))))
        .when(k == 6, cut_at("hex", 40, 64, 32))
        .when(k == 7, F.substring(F.translate("hex", "abcdef", "012345"), F.lit(1), F.lit(16) + pick("digits", 4)))
        .when(k == 8, word("long", 16, 30))
        .when(k == 9, one_of("case", F.upper(word("long", 16, 30)), F.initcap(word("long", 16, 30))))
        .when(k == 10, F.concat_ws("/", one_of("d1", "src", "lib", "usr", "docs"), word("d2", 4, 9), word("d3", 5, 10), one_of("d4", "index", "main", "util")))
        .when(k == 11, one_of("fill", "your_api_key_here", "example-token-0000", "xxxxxxxxxxxxxxxxxxxx", "INSERT_SECRET_HERE", "password_placeholder", "test_access_token_1", "00000000000000000000"))
        .when(k == 12, F.concat_ws("-", F.substring("hex", 1, 8), F.substring("hex", 9, 4), F.substring("hex", 13, 4), F.substring("hex", 17, 4), F.substring("hex", 21, 12)))
        .when(k == 13, F.concat_ws("-", one_of("r", "report", "version", "document"), F.lit("2024"), F.lpad((pick("m", 12) + 1).cast("string"), 2, "0"), one_of("e", "final", "archive2", "list01")))
        .when(k == 14, F.concat(F.initcap(word("c1", 4, 8)), one_of("c2", "Request", "Handler", "Manager"), F.initcap(word("c3", 4, 8)), one_of("c4", "V2", "Factory", "Test")))
        .when(k == 15, F.concat_ws("_", word("w1", 4, 9), word("w2", 4, 9), word("w3", 3, 8)))
        .when(k == 16, F.concat(F.initcap(word("p1", 2, 6)), one_of("sign1", "!", "#", "$9", "7", "@2", "_x4"), F.substring("mixed", 1, 4), one_of("sign2", "", "?", "%", "+1")))
        .when(k == 17, one_of("plain", "required", "optional", "string", "changeme", "undefined", "incorrect", "something", "nothing.", "forgotten", "process.env.TOKEN", "os.environ", "********", "${TOKEN}", "%(secret)s", "<hidden>"))
        .when(k == 18, F.concat(word("v1", 6, 12), one_of("v2", "", ".", "!")))
        .otherwise(_let(one_of("pem", "PRIVATE", "RSA PRIVATE", "EC PRIVATE", "OPENSSH PRIVATE"), lambda n: F.concat(
            F.lit("-----BEGIN "), n, F.lit(" KEY-----"), F.when(pick("whole", 2) == 0, F.concat(F.lit("\n"), "mixed", F.lit("\n"), F.reverse("mixed"), F.lit("=\n-----END "), n, F.lit(" KEY-----"))).otherwise(""))))
    )
    sure = (F.col("kind") <= 5) | F.col("kind").isin(16, 19)
    before = (
        F.when((sure & ~k.isin(5, 19)) | k.isin(17, 18), F.concat(prose, assign))
        .when(k == 5, F.concat(prose, one_of("maybe", assign, F.lit(""))))
        .when(k == 6, F.concat(prose, one_of("benign", "commit ", "sha256:", "checksum ", "md5=", 'etag: "', "digest = ", "artifact_sha256_checksum: ", 'release_commit_digest = "')))
        .when(k == 11, F.concat(prose, assign))
        .when(k == 12, F.concat(prose, one_of("uuid", "id: ", "uuid ", "request ", "")))
        .otherwise(prose)
    )
    quote = F.when(before.rlike("[\"']$"), F.right(before, F.lit(1))).otherwise("")
    some = lambda *paths: one_of("path", *paths, "", "", "", "")
    path = F.when(sure, some("deploy/prod.env", "config/settings.yaml", "src/app.py", "infra/main.tfvars")).otherwise(some("tests/test_app.py", "docs/readme.md", "examples/demo.ini", "src/app.py"))
    return rows_df.select(
        candidate.alias("candidate"), F.right(before, F.lit(48)).alias("before"), F.left(F.concat(quote, F.lit(" "), word("right", 3, 8)), F.lit(24)).alias("after"),
        path.alias("path"), sure.cast("double").alias("label"),
    )


def train(findings: DataFrame, trees: int = 40, depth: int = 9, seed: int = 7, max_rows: int = 100_000, words: Iterable[str] = ()) -> PipelineModel:
    """A forest of labelled findings; of more than ``max_rows`` the first by a hash of the candidate are taken. ``words`` (:func:`frequent_words`) join the dictionary, and must when it judges."""
    taken = findings.orderBy(F.xxhash64("candidate"), "candidate").limit(max_rows)
    rows, names = features(cut(taken, "findings"), words)
    stages = [VectorAssembler(inputCols=names, outputCol="inputs"), RandomForestClassifier(featuresCol="inputs", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)]
    return Pipeline(stages=stages).fit(rows.fillna(0.0, names))


def judge(findings: DataFrame, model: PipelineModel, words: Iterable[str] = ()) -> DataFrame:
    """Adds ``probability`` (of being a secret) to findings."""
    rows, names = features(findings, words)
    scored = model.transform(rows.fillna(0.0, names))
    return scored.withColumn("probability", vector_to_array("probability")[1]).select(*findings.columns, "probability")


def scan(docs: DataFrame, model: PipelineModel, threshold: float = 0.5, path_col: str | None = None, keep_rejected: bool = False, words: Iterable[str] = (), **columns: str) -> DataFrame:
    """``doc_id, start, length, secret_sha256, probability, is_secret`` per finding; the secret itself stays out.

    Only findings of ``threshold`` or more are returned, or all with ``keep_rejected``. Documents
    without findings have no rows; rows that repeat have their own findings; ids may be null.
    """
    found = judge(candidates(docs, path_col=path_col, **columns), model, words)
    out = found.select(
        "doc_id", F.col("start").cast("long").alias("start"), F.length("candidate").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("secret_sha256"), "probability", (F.col("probability") >= threshold).alias("is_secret"),
    )
    return out if keep_rejected else out.where("is_secret")
