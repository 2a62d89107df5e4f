"""Secret scan: candidates by pattern, false positives removed by a random forest. DataFrame and SQL functions only.

The forest is trained once by Spark ML from labelled findings. For scoring its trees become one SQL expression, so a document is scanned, scored and
masked inside its own row: nothing is exploded, shuffled or joined.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from voxtally.functions.exprs import let, settle
from voxtally.llm.tables import store

#: Documents whose words make up the default labelled findings (expected number of a hash sample).
LABELLED_DOCS = 2_000
TREES, DEPTH, SEED = 20, 7, 11
#: Entries of the two dictionaries, taken from the sampled documents.
WORDS, TRIGRAMS = 400, 800
MASK = "[SECRET]"
#: Characters of the neighbourhood that is looked at.
AROUND = 64

# Fixed values. A candidate is a run of at least 8 of these characters that holds a digit or begins like a provider's key, a quoted value of at
# least 8 characters, or any value (of any length and characters, quoted ones with blanks too) after a credential word and = or :.
_RUN = r"[A-Za-z0-9_+/.~:@%\-]"
_BLANK, _QUOTE = r"[ \t\r\n\x0b\f\u00a0\u2028\u3000]", r"[\"'`]"
_NEAR, _MARK = r"[ \t\"'`]", "[=:\uff1a\uff1d]"
_PROVIDER = r"(?:AKIA|ASIA|gh[pousr]_|sk_live_|xox[abp]-|AIza)"
_DIGIT = r"(?=[A-Za-z_+/.~:@%\-]*+[0-9])"
_WORDS = ("pass", "password", "passwd", "passphrase", "passcode", "passwort", "kennwort", "contraseña", "clave", "senha", "mot de passe", "pwd", "secret", "token", "key", "auth", "authorization", "credential", "credentials")


def _after_credential(last: str) -> str:
    """Looks behind for a credential word, = or :, and ``last``: each alternative has one width, as any engine can do."""
    by_length: dict[int, list[str]] = {}
    for word in _WORDS:
        by_length.setdefault(len(word), []).append(word)
    ways = [f"(?<=(?i:bearer){_BLANK}{last})"]
    for after in ("", _BLANK, _BLANK * 2):
        tails = [before + mark + after + last for before in ("", _NEAR, _NEAR * 2) for mark in (_MARK, "=>", ":=")]
        words = "|".join(f"(?<=(?i:{'|'.join(w)}){t})" for t in tails for w in by_length.values())
        ways.append(f"(?<=[=:>\uff1a\uff1d]{after}{last})(?:{words})")
    return "(?:" + "|".join(ways) + ")"


# The value ends at a blank, at a quote, or where the next name and = or : begin; it does not begin with what belongs to the mark.
_NAMED = r"[?&;,|][A-Za-z_\-]{1,24}+[=:]"
_CLOSING = rf"[.,;:)\]}}>]{{1,8}}+(?![^\"'` \t\r\n\x0b\f\u00a0\u2028\u3000])"
_VALUE = rf"(?!{_QUOTE}|[=:]|(?<==)>)(?:(?!{_QUOTE}(?![A-Za-z0-9])|{_NAMED}|{_CLOSING})[^ \t\r\n\x0b\f\u00a0\u2028\u3000])++"
# A quoted value with blanks in it, unless it holds a run that is looked at by itself.
_PHRASE = rf"(?![^\"'`\r\n]{{0,100}}?(?<!{_RUN})(?:{_PROVIDER}|{_DIGIT}{_RUN}{{8}}))[^\"'`\r\n=:]{{1,100}}+(?={_QUOTE})"
_QUOTED = rf"(?<={_QUOTE})[^\"'`=:,; \t\r\n\x0b\f\u00a0\u2028\u3000]{{8,}}+(?={_QUOTE})"
# A run ends before the marks that close a sentence, may end in the padding of base64, and begins after a leading 'word:'.
_LONG = rf"(?:(?![.:]{{1,8}}+(?!{_RUN})){_RUN}){{8,}}+(?:(?<=[A-Za-z0-9+/]{{15}})={{1,2}}+(?![A-Za-z0-9=\"'`]))?+"
_LABEL = rf"(?!(?!{_PROVIDER})(?:[A-Za-z_\-]{{2,24}}+|(?i:sha-?[0-9]{{1,3}}|md5)):(?!/))"
CANDIDATE = (
    rf"(?<![A-Za-z0-9])(?:(?<={_QUOTE}){_after_credential(_QUOTE)}(?:{_PHRASE}|{_VALUE})|(?<=[=:>\uff1a\uff1d]|{_BLANK}){_after_credential('')}(?!bearer{_BLANK}|Bearer{_BLANK}){_VALUE}"
    rf"|{_QUOTED}|(?:(?<!{_RUN})|(?<=[A-Za-z_0-9\-]:)){_LABEL}(?:{_DIGIT}|(?={_PROVIDER})){_LONG}|(?={_PROVIDER}){_LONG})"
)
_CREDENTIAL = r"(?i)(pass(word|wd|phrase|code|wort)?|kennwort|contraseña|clave|senha|mot de passe|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|auth(orization)?|bearer|credentials?)"
_HARMLESS = r"(?i)(commit|sha-?1|sha-?256|md5|checksum|digest|etag|uuid|order|invoice|version|example|sample|phone|card)"
_PLACEHOLDER = r"(?i)^(null|none|nil|true|false|yes|no|required|optional|missing|empty|unknown|hidden|redacted|invalid|expired|n/a|tbd|[*.x_#-]+|<.*>?|[$%]?[{(].*|\$[a-z_]+|%[a-z_]+%|your.*|change.?me.*|example.*|placeholder.*|todo.*)$"
_COMMON = ("www", "http", "https", "com", "org", "net", "mail", "example", "usr", "lib", "bin", "home", "etc", "var", "src", "test", "file", "user", "your", "changeme", "placeholder", "version", "index", "html", "json")


#: Stands for a candidate while a text is split; texts that hold it themselves are split by the pattern.
_APART = "\ufdd0"


def candidates(text: Column) -> tuple[Column, Column]:
    """(the candidates, the n + 1 stretches of text around them)."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    # split() compiles a long pattern anew for each row, regexp_replace() does not
    parted = F.split(F.regexp_replace(text, CANDIDATE, _APART), _APART)
    return F.coalesce(found, F.array().cast("array<string>")), F.when(F.contains(text, F.lit(_APART)), F.split(text, CANDIDATE)).otherwise(parted)


def _share(text: Column, drop: str) -> Column:
    """Share of the characters that are left without those matching ``drop``."""
    return F.length(F.regexp_replace(text, drop, "")) / F.length(text)


def features(c: Column, before: Column, after: Column, words: list[str], trigrams: list[str]) -> dict[str, Column]:
    """The numbers the forest sees: length, transitions, dictionary coverage, path form and neighbouring words of a candidate."""
    n = F.length(c)
    low = F.lower(c)
    changes = F.length(F.regexp_replace(c, r"(?<=[0-9])(?=[^0-9])|(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])", "#")) - n
    known = F.filter(F.split(low, "[^a-z]+"), lambda w: w.isin(words))
    covered = F.aggregate(known, F.lit(0), lambda s, w: s + F.length(w)) / n
    spelled = F.aggregate(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), F.lit(0), lambda s, i: s + F.substr(low, i, F.lit(3)).isin(trigrams).cast("int")) / n
    last = F.substr(before, F.greatest(F.lit(1), F.length(before) - 24))
    flag = lambda x: x.cast("double")
    return {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in {
        "length": n, "transitions": changes / n, "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(32)),
        "digits": _share(c, "[^0-9]"), "padded": flag(c.rlike("=$")), "upper": _share(c, "[^A-Z]"), "lower": _share(c, "[^a-z]"), "hex": flag(c.rlike("^[0-9a-fA-F]+$")),
        "word_coverage": covered, "spelling": spelled,
        "slashes": n - F.length(F.replace(c, F.lit("/"))), "dots": n - F.length(F.replace(c, F.lit("."))), "dashes": n - F.length(F.replace(c, F.lit("-"))),
        "at": flag(F.contains(c, F.lit("@"))), "path": flag(c.rlike(r"^(/|\./|~/|[a-z]+://)|/.*/")), "numeric": flag(c.rlike(r"^[-+0-9.:/]+$")),
        "provider": flag(c.rlike(r"^(AKIA|ASIA|gh[pousr]_|sk_live_|xox[abp]-|AIza)")),
        "credential": flag(last.rlike(_CREDENTIAL)), "harmless": flag(last.rlike(_HARMLESS)), "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "tight": flag(before.rlike(r"[=:][\"']?$")), "letters": _share(c, r"[^\p{L}]"), "marks": _share(c, r"[\p{L}\p{N}\s]"), "blanks": _share(c, r"\S"), "placeholder": flag(c.rlike(_PLACEHOLDER)),
        "quoted": flag(before.rlike(r"[\"']$") & after.rlike(r"^[\"']")),
    }.items()}


def labelled_findings(docs: DataFrame) -> DataFrame:
    """``text, secret``: short texts, some of which hold one secret, made from the words of sampled documents.

    The neighbourhood comes from the documents (without digits); secrets are drawn from hashes in the usual forms; the rest are the forms
    that scanners take for secrets: addresses, numbers, paths, names, digests, identifiers and placeholders, some after credential words.
    """
    total = docs.count()
    texts = docs.where(F.col("text").isNotNull()).where(F.pmod(F.xxhash64("doc_id", F.substr("text", F.lit(1), F.lit(64))), F.lit(1 << 20)) < F.lit(min(1.0, LABELLED_DOCS / max(1, total)) * (1 << 20)))
    at = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.length("text") - 160)).cast("int") + 1
    base = texts.select(F.regexp_replace(F.substr("text", at, F.lit(160)), "[0-9\"'=:]", " ").alias("near"), F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.col("text")), 256).alias("h"))
    base = base.dropDuplicates(["h"]).withColumn("w", F.coalesce(F.nullif(F.lower(F.regexp_extract("near", "([A-Za-z]{3,})", 1)), F.lit("")), F.lit("word")))
    h = lambda salt, n: F.substr(F.sha2(F.concat("h", F.lit(salt)), 256), F.lit(1), F.lit(n))
    digits = lambda salt, n: F.substr(F.translate(h(salt, 64), "abcdef", "123456"), F.lit(1), F.lit(n))
    mixed = lambda salt, n: F.substr(F.translate(F.base64(F.unhex(h(salt, 64))), "+/=", "xYz"), F.lit(1), F.lit(n))
    letters = lambda salt, n: F.substr(F.translate(F.base64(F.unhex(h(salt, 64))), "0123456789+/=", "qWeRtYuIoPaSd"), F.lit(1), F.lit(n))
    full = lambda salt, n: F.substr(F.base64(F.unhex(h(salt, 64))), F.lit(1), F.lit(n))
    marked = lambda salt, n: F.translate(full(salt, n), "QZ", "+/")
    w, text = F.col("w"), lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    w2, w3 = (F.coalesce(F.nullif(F.get(F.regexp_extract_all("near", F.lit("([A-Za-z]{3,})"), F.lit(1)), F.lit(i)), F.lit("")), F.lit(d)) for i, d in ((1, "horse"), (2, "battery")))
    vary = F.pmod(F.xxhash64("h"), F.lit(24)).cast("int")
    secret = [
        ('token = "', F.substr(h("a", 64), F.lit(1), 16 + vary), '"'), ("password=", F.substr(h("b", 64), F.lit(1), 10 + vary), ""), ("api_key: ", h("c", 32), ""),
        ("secret='", mixed("d", 24), "'"), ("", text("AKIA", F.upper(mixed("e", 16))), ""), ("", text("AKIA", F.upper(mixed("o", 16))), "."), ("", text("ghp_", mixed("f", 36)), ""), ("Authorization: Bearer ", mixed("g", 40), ""), ("key=", text("sk_live_", mixed("i", 24)), ""),
        ("pwd: ", mixed("j", 14), ""), ('"access_key": "', F.upper(mixed("k", 20)), '"'),
        ("password=", text(F.initcap(w), F.initcap(w2), F.initcap(w3)), ""), ("password: ", text(F.initcap(w), F.initcap(w3)), ""), ("password=", F.lower(w2), ""), ('password = "', text(w, " ", w2, " ", w3), '"'),
        ("api_key=", full("P", 44), ""), ("secret: ", full("Q", 40), "."), ("token:", mixed("R", 16), ""), ("token:", F.substr(h("S", 64), F.lit(1), 12 + vary), "."), ("aws_secret_access_key = ", text(marked("T", 20), "/", marked("U", 19)), ""), ("Authorization: Bearer ", text(mixed("V", 20), ".", mixed("W", 30), ".", mixed("X", 20)), "."), ("", text("ghp_", mixed("Y", 36)), "."), ("password=", text(mixed("Z", 5), ".", mixed("AA", 6)), "."),
        ("pwd: ", mixed("A", 7), ""), ("passwd=", mixed("B", 5), ""), ("password=", text(mixed("C", 4), "!", letters("D", 4), "#", mixed("E", 2)), ""), ("password: ", text(letters("F", 3), "$", mixed("G", 3), "&", letters("H", 2)), ""),
        ("secret: ", letters("I", 20), ""), ('token = "', letters("J", 24), '"'), ("Authorization: Bearer ", letters("K", 32), ""), ("", text("AKIA", F.upper(letters("L", 16))), ""), ("", text("ghp_", letters("M", 36)), ""), ('"', mixed("N", 32), '"'), ('"', letters("O", 32), '"'),
    ]
    other = [
        ("", text(w, ".", digits("a", 2), "@mail", digits("b", 1), ".example.com"), ""), ("", text(digits("c", 3), ".", digits("d", 2), ".", digits("e", 3), ".", digits("f", 1)), ""), ("", digits("g", 16), ""), ("+1 (", text(digits("i", 3), ") 555-", digits("j", 4)), ""), ("", digits("k", 10), ","),
        ("", text("/usr/lib/", w, "/", w, digits("l", 1), ".so"), ""), ("", text("https://www.", w, ".com/", w, "/", digits("m", 5), ".html"), ""), ("", text(w, "_", w, digits("n", 2)), ""), ("", text("20", digits("o", 2), "-0", digits("p", 1), "-1", digits("q", 1), "T10:00:00"), ""), ("version ", text("v", digits("r", 1), ".", digits("s", 1), ".", digits("t", 2), "-", w), ""),
        ("password=", text("changeme", digits("u", 3)), ""), ('token = "', text("your_token_", digits("v", 1)), '"'), ("password: ", text("example", digits("w", 4)), ""), ("commit ", h("x", 40), ""), ("md5 ", h("y", 32), ""), ("uuid ", text(h("z", 8), "-", h("1", 4), "-", h("2", 4), "-", h("3", 4), "-", h("4", 12)), ""), ("sha256:", h("5", 64), ""), ("order ", text("A", digits("6", 9)), ""),
        ("password: ", F.lower(w2), ""), ("secret: ", F.lower(w3), ""), ("token: ", F.lower(w), ""), ("key: ", F.lower(w2), ""), ("key: ", F.initcap(w3), ""), ("key=", digits("8", 3), ""), ("token = ", "null", ""), ("password: ", "required", ""), ("password=", "<password>", ""), ("token=", "${TOKEN}", ""), ("password: ", "********", ""),
        ('"', text(F.lower(w), F.lower(w2), "ing"), '"'), ("'", text(F.lower(w), "_", F.lower(w3), "_name"), "'"), ('"', "password", '": '), ('"', text(F.initcap(w), F.initcap(w2), "Service"), '"'), ('password = "', "your password here", '"'), ('secret: "', text("the ", w2, " of this ", w3, " is"), '"'),
        ("", text(w, digits("7", 4), w), ""), ("", text(w, "-", digits("8", 2), "/", w), "."),
    ]
    rows = [F.struct(text(" ", left, c, right, " ").alias("said"), (c if i < len(secret) else F.lit(None).cast("string")).alias("secret")) for i, (left, c, right) in enumerate([*secret, *other])]
    half = F.floor(F.length("near") / 2).cast("int")
    # Bound in a lambda: written out, the forms are more code than a generated method may hold, and the driver would build and compile it in vain.
    forms = let(F.array(*rows), lambda all_forms: all_forms)
    each = base.select("near", half.alias("half"), F.inline(forms))
    return each.select(F.concat(F.substr("near", F.lit(1), F.col("half")), "said", F.substr("near", F.col("half") + 1)).alias("text"), "secret")


def _findings(docs: DataFrame, *keep: str) -> DataFrame:
    """A row for each candidate: ``keep``, its number, start, the candidate and the text around it."""
    found, around = candidates(F.col("text"))
    split = settle(docs, _found=found, _around=around).where(F.size("_found") > 0)
    gaps = F.zip_with(F.slice("_around", F.lit(1), F.size("_found")), F.col("_found"), lambda p, c: (F.length(p) + F.length(c)).cast("long"))
    split = settle(split, _starts=F.zip_with(_before(gaps), F.slice("_around", F.lit(1), F.size("_found")), lambda t, p: t + F.length(p)))
    split = split.select(*keep, "_around", F.posexplode(F.arrays_zip("_found", "_starts")).alias("finding", "_x"))
    before, after = F.get("_around", F.col("finding")), F.get("_around", F.col("finding") + 1)
    return split.select(*keep, "finding", F.col("_x._starts").alias("start"), F.col("_x._found").alias("candidate"), F.right(before, F.lit(AROUND)).alias("before"), F.left(after, F.lit(AROUND)).alias("after"))


def _before(values: Column, block: int = 256) -> Column:
    """For each value the sum of those before it. By blocks, since a growing array is copied at each step."""
    def run(of: Column, first: Column) -> Column:
        start = F.struct(F.array().cast("array<long>").alias("a"), first.alias("t"))
        return F.reduce(of, start, lambda s, x: F.struct(F.array_append(s["a"], s["t"]).alias("a"), (s["t"] + x).alias("t")))["a"]

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, F.lit(block)))
    return let(parts, lambda p: F.flatten(F.zip_with(p, run(F.transform(p, lambda x: F.reduce(x, F.lit(0).cast("long"), lambda s, v: s + v)), F.lit(0).cast("long")), run)))


class Scanner:
    """A trained forest with its dictionaries."""

    def __init__(self, forest: RandomForestClassificationModel | None, names: list[str], words: list[str], trigrams: list[str]):
        self.forest, self.names, self.words, self.trigrams = forest, names, words, trigrams
        self.trees = [] if forest is None else _trees(forest.toDebugString)

    def score(self, c: Column, before: Column, after: Column) -> Column:
        """Share of the trees that take the candidate for a secret."""
        if not self.trees:
            return F.lit(0.0)
        given = features(c, before, after, self.words, self.trigrams)
        vector = F.struct(*[given[n].alias(n) for n in self.names])
        return let(vector, lambda v: reduce(lambda a, b: a + b, [_tree(t, v, self.names) for t in self.trees]) / len(self.trees))


def _trees(described: str) -> list:
    """The trees of a forest's description: (feature, threshold, left, right) or a predicted class."""
    out = []
    for part in re.split(r"\n\s*Tree \d+[^\n]*\n", described)[1:]:
        lines = [x.strip() for x in part.strip().split("\n")]

        def parse(i: int) -> tuple:
            if lines[i].startswith("Predict:"):
                return float(lines[i].split(":")[1]), i + 1
            feature, threshold = re.match(r"If \(feature (\d+) <= ([-+0-9.eE]+)\)", lines[i]).groups()
            left, i = parse(i + 1)
            right, i = parse(i + 1)  # the line between says Else
            return (int(feature), float(threshold), left, right), i

        out.append(parse(0)[0])
    return out


def _tree(node, vector: Column, names: list[str]) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, left, right = node
    if left == right:
        return _tree(left, vector, names)
    return F.when(vector[names[feature]] <= threshold, _tree(left, vector, names)).otherwise(_tree(right, vector, names))


def train(docs: DataFrame, labelled: DataFrame | None = None) -> Scanner:
    """A forest from ``labelled`` (``text, secret``; by default ``labelled_findings``); dictionaries are the frequent words and trigrams of it.

    A candidate is positive if it is its text's secret. Without positives or negatives nothing is taken for a secret.
    """
    labelled = store(labelled_findings(docs) if labelled is None else labelled, "labelled-findings")
    plain = F.lower(F.regexp_replace("text", CANDIDATE, " "))
    words = labelled.select(F.explode(F.split(plain, "[^a-z]+")).alias("w")).where(F.length("w") >= 3)
    top = [r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(WORDS).collect()]
    parts = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substr("w", i, F.lit(3)))).alias("t"))
    trigrams = [r["t"] for r in parts.groupBy("t").count().orderBy(F.desc("count"), "t").limit(TRIGRAMS).collect()]
    top = [*dict.fromkeys([*top, *_COMMON])]
    found = _findings(labelled, "text", "secret")
    given = features(F.col("candidate"), F.col("before"), F.col("after"), top, trigrams or ["-"])
    names = list(given)
    rows = store(found.select((F.coalesce(F.col("candidate") == F.col("secret"), F.lit(False))).cast("double").alias("label"), *[v.alias(k) for k, v in given.items()]), "finding-features")
    kinds = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(kinds) < 2:
        return Scanner(None, names, top, trigrams or ["-"])
    ready = VectorAssembler(inputCols=names, outputCol="features").transform(rows)
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(ready)
    return Scanner(forest, names, top, trigrams or ["-"])


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """``doc_id, finding, start, length, score, is_secret, candidate_sha256``: every candidate of every whole text, judged.

    ``start`` counts characters from 0. The candidate itself is given as a digest only. Null and empty texts, and texts without candidates, give
    no rows; repeated rows give theirs each; null ids are kept; other columns are ignored.
    """
    found = settle(_findings(docs.select("doc_id", "text"), "doc_id"), score=scanner.score(F.col("candidate"), F.col("before"), F.col("after")))
    return found.select("doc_id", "finding", "start", F.length("candidate").alias("length"), "score", (F.col("score") > 0.5).alias("is_secret"), F.sha2("candidate", 256).alias("candidate_sha256"))


def mask(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """The same rows and columns, with MASK in place of each secret in ``text``. Each row is worked on by itself."""
    found, around = candidates(F.col("text"))
    split = settle(docs.select(F.struct("*").alias("kept"), "text"), _found=found, _around=around)

    def judged(c: Column, i: Column) -> Column:
        before, after = F.right(F.get("_around", i), F.lit(AROUND)), F.left(F.get("_around", i + 1), F.lit(AROUND))
        return F.concat(F.get("_around", i), F.when(scanner.score(c, before, after) > 0.5, F.lit(MASK)).otherwise(c))

    whole = F.concat(F.array_join(F.transform("_found", judged), ""), F.get("_around", F.size("_found")))
    return split.withColumn("kept", F.col("kept").withField("text", F.when(F.size("_found") > 0, whole).otherwise(F.col("text")))).select("kept.*")
