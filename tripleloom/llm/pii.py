"""Personal data by candidate gradient boosting, in DataFrame functions alone.

Base spans (email, ip, card, phone) follow fixed patterns and checks and always stay.
Further generators with high recall propose spans that may overlap each other and the base
ones: spelled-out mail addresses, phone numbers without a plus, cards with odd
separators, IPv6 addresses, and opaque strings that may be keys, tokens or passwords (kind
``secret``). Format and context features of each candidate go through boosted trees (depth
three, logistic loss), compiled to CASE expressions; a threshold for each kind, calibrated
on held-out examples, selects what is added. A candidate within a base span adds nothing
and goes; of chosen candidates that overlap, the best-scored stays (of equal ones the first).

The trees are fitted on the driver to a fixed, generated set of examples (``EXAMPLES`` of
each form, in four languages), whose features come from the same Column expressions. Data
never leave the JVM: no UDF, pandas, Arrow or RDD on the path of the documents, no
shuffle, one row in and one row out.

Positions come from the matches and the text between them, summed along the text; repeats
in the patterns are possessive or anchored at the start of a run, which changes no match
and keeps long runs of digits or letters linear and off the regex engine's stack.

Defined cases: null counts as empty; empty texts have no spans and the digest of the
empty string; texts of any length are read in whole; rows are independent, so repeated rows,
null ids among them, give repeated results; an empty table gives no rows; extra columns are
ignored unless kept.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = "[A-Za-z0-9._%+-]"
#: kind -> pattern; a match cannot start inside a run that the pattern's first class would take whole, unless a match has just ended there.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match passes.
_MAY = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_AT, _DOT = r"(?: ?[\[(]at[\])] ?| at |@)", r"(?: ?[\[(]dot[\])] ?| dot |\.)"
#: name -> (kind, pattern) of the generators.
GENERATORS = {
    "spelled": ("email", rf"(?<![A-Za-z0-9._-])[A-Za-z0-9][A-Za-z0-9._-]{{0,63}}+{_AT}[A-Za-z0-9][A-Za-z0-9-]{{0,62}}(?:{_DOT}[A-Za-z][A-Za-z0-9-]{{1,24}}){{1,4}}"),
    "national": ("phone", r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)|[0-9]{2,5})[ ./-][0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,3}(?![0-9A-Za-z])"),
    "separated": ("card", r"(?<![0-9])[0-9]{4}[._/][0-9]{4}[._/][0-9]{4}[._/][0-9]{2,4}(?![0-9])"),
    "opaque": ("secret", r"(?<![A-Za-z0-9_+/=.-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{12,512}+(?![A-Za-z0-9_+/=-])"),
    "ipv6": ("ip", r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])"),
}
#: Cheap tests that every text with a match of a generator passes.
_WORTH = {"spelled": r"(?i)\bat\b|@", "national": "[0-9]{2}[)]?[ ./-][0-9]{2}", "separated": "[0-9]{4}[._/][0-9]{4}", "opaque": "[0-9]"}
#: Words before a span that speak for personal data, by kind.
CUES = {
    "email": r"(?i)(e-?mail|mail|contact|write|kontakt|schreib|correo|courriel|adresse)",
    "phone": r"(?i)(phone|tel|call|mobile|fax|telefon|anruf|rufen|appel|llama|movil|portable)",
    "card": r"(?i)(card|visa|master|credit|karte|carte|tarjeta|payment)",
    "ip": r"(?i)(\bip|address|server|host|client|login|serveur|adresse)",
    "secret": r"(?i)(token|secret|key|passw|pwd|bearer|credential|auth|clave|kennwort|schl.ssel|contrase|mot de passe|jeton)",
}
AGAINST = r"(?i)(version|isbn|issn|order|invoice|build|release|date|article|page|section|datum|fecha|chapter|doi|commit|revision|sha|md5|checksum|digest|hash|etag|uuid|file|image|url)"
EXAMPLES, TREES, DEPTH, RATE, PRECISION = 60, 40, 3, 0.4, 0.97
CONTEXT = 28


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(x)

    def term(i):
        d = F.ascii(F.substring(x, n - i + 1, F.lit(1))) - 48
        return F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.when(n > 0, F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, t: a + t) % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(m))).otherwise(F.lit(False))
    return n.between(10, 15)


_SPAN = "array<struct<s:int,k:int,e:int,m:string>>"


def spans(text: Column, kind: str, pattern: str, valid=None) -> Column:
    """Array of (start, kind number, end, match) of the matches of ``pattern`` that are ``valid``; code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    k = KINDS.index(kind)

    def step(acc, x):
        s = acc["at"] + F.length(x["g"])
        e = s + F.length(x["m"])
        one = F.array(F.struct(s.alias("s"), F.lit(k).alias("k"), e.alias("e"), x["m"].alias("m")))
        out = F.concat(acc["out"], one) if valid is None else F.when(valid(x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(e.alias("at"), out.cast(_SPAN).alias("out"))

    zipped = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def _empty():
    return F.array().cast(_SPAN)


def base_spans(text: Column) -> Column:
    """The base spans of a text by start, then kind."""
    each = []
    for kind in BASE:
        may = F.contains(text, F.lit(_MAY[kind])) if _MAY[kind] else F.lit(True)
        each.append(F.when(may, spans(text, kind, BASE[kind], lambda m, k=kind: _valid(k, m))).otherwise(_empty()))
    return F.array_sort(F.concat(*each))


def candidates(text: Column) -> Column:
    """What the generators propose, base patterns aside."""
    each = []
    for name, (kind, pattern) in GENERATORS.items():
        may = F.contains(text, F.lit(":")) if name == "ipv6" else F.regexp_like(text, F.lit(_WORTH[name]))
        each.append(F.when(may, spans(text, kind, pattern)).otherwise(_empty()))
    return F.array_sort(F.concat(*each))


FEATURES = ("kind", "length", "digits", "groups", "marks", "letters", "spaces", "luhn", "cue", "against", "letter_before", "ends_sentence", "spelled", "year", "last_group", "hex", "two_cases", "assigned", "longest_word")


def features(text: Column, x: Column) -> Column:
    """Struct of doubles: format of a candidate and its context."""
    m = x["m"]
    before = F.substring(text, F.greatest(x["s"] + 1 - CONTEXT, F.lit(1)), F.least(x["s"], F.lit(CONTEXT)))
    after = F.substring(text, x["e"] + 1, F.lit(1))
    flag = lambda c: c.cast("double")
    n = lambda p: F.length(F.regexp_replace(m, p, "")).cast("double")
    cue = F.lit(False)
    for k, kind in enumerate(KINDS):
        cue = cue | ((x["k"] == k) & F.regexp_like(before, F.lit(CUES[kind])))
    values = {
        "kind": x["k"].cast("double"),
        "length": F.length(m).cast("double"),
        "digits": n("[^0-9]"),
        "groups": F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))).cast("double"),
        "marks": n("[A-Za-z0-9 ]"),
        "letters": n("[^A-Za-z]"),
        "spaces": n("[^ ]"),
        "luhn": flag(luhn(_digits(m))),
        "cue": flag(cue),
        "against": flag(F.regexp_like(before, F.lit(AGAINST))),
        "letter_before": flag(F.regexp_like(before, F.lit("[A-Za-z0-9]$"))),
        "ends_sentence": flag(F.regexp_like(after, F.lit("^[.,;\\n)]?$"))),
        "spelled": flag(F.regexp_like(m, F.lit(r"[\[(](at|dot)[\])]"))),
        "year": flag(F.regexp_like(m, F.lit(r"(^|[^0-9])(19|20)[0-9]{2}([^0-9]|$)"))),
        "last_group": F.length(F.regexp_extract(m, "([0-9]*)$", 1)).cast("double"),
        "hex": flag(F.regexp_like(m, F.lit("^([0-9a-f]+|[0-9A-F]+)$"))),
        "two_cases": flag(F.regexp_like(m, F.lit("[a-z]")) & F.regexp_like(m, F.lit("[A-Z]"))),
        "assigned": flag(F.regexp_like(before, F.lit("[=:] *[\"']?$"))),
        "longest_word": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(m, F.lit("[a-z]+|[A-Z]+"), F.lit(0)), F.length)), F.lit(0)).cast("double"),
    }
    return F.struct(*[values[f].alias(f) for f in FEATURES])


# --- the boosted trees -------------------------------------------------------------------


def examples(seed: int = 1) -> list[tuple[str, int]]:
    """Generated texts with one candidate each, and whether it is personal data."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: r.choice(["anna", "j.doe", "m_lopez", "pierre", "k-schmidt", "info", "x91", "ana.ruiz"])
    host = lambda: r.choice(["example", "mailbox", "posteo", "corp-net", "uni-lab"])
    top = lambda: r.choice(["com", "org", "de", "fr", "es", "net"])
    cue = {
        "email": ["email: ", "contact me: ", "Kontakt ", "correo: ", "courriel : ", "write to "],
        "phone": ["call ", "phone: ", "Tel. ", "Telefon ", "appel au ", "llama al ", "fax "],
        "card": ["card ", "visa ", "Karte ", "carte ", "tarjeta "],
        "ip": ["ip ", "server ", "host ", "login from ", "serveur "],
    }
    plain = ["we met ", "the ", "und dann ", "puis ", "luego ", "it was ", "", "about "]
    bad = ["version ", "ISBN ", "order ", "invoice ", "build ", "date ", "page ", "section ", "doi "]
    out = []

    def hex4():
        return "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4)))

    def secret():
        kind, n = r.randrange(4), r.randint(20, 44)
        if kind == 0:
            x = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([24, 32, 40, 48, 64])))
        elif kind == 1:
            x = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
        elif kind == 2:
            x = "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789_-") for _ in range(n))
        else:
            x = r.choice(["sk_live_", "AKIA", "ghp_", "pk-"]) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
        x = x + r.choice("0123456789")
        return x.upper() if r.random() < 0.2 else x

    words = ["house", "image", "report", "final", "version", "page", "article", "guide", "summer", "bericht", "maison", "tabla", "and", "the", "of", "to"]
    slug = lambda: r.choice("-_").join([r.choice(words) for _ in range(r.randint(2, 5))] + [d(r.randint(1, 4))])
    hold = ["token = \"", "api_key: ", "secret = '", "password=", "Authorization: Bearer ", "TOKEN = \"", "access key ", "clave: ", "Kennwort: ", "jeton = ", "auth_token=", "private key: "]
    loose = ["commit ", "sha256: ", "md5 ", "checksum = ", "revision ", "etag: \"", "uuid ", "build ", "file ", "hash: "]

    for _ in range(EXAMPLES):
        for lead, y in ((r.choice(cue["email"]), 1), (r.choice(plain), 1)):
            out.append((f"{lead}{name()} {r.choice(['(at)', '[at]'])} {host()} {r.choice(['(dot)', '[dot]'])} {top()} ok", y))
        out.append((f"{r.choice(cue['email'])}{name()} at {host()} dot {top()}", 1))
        out.append((f"{r.choice(plain)}looked at home.{r.choice(['then', 'she', 'and', 'we'])} went", 0))
        out.append((f"{r.choice(plain)}arrived at noon dot then left", 0))
        for lead, y in ((r.choice(cue["phone"]), 1), (r.choice(bad), 0)):
            out.append((f"{lead}({d(3)}) {d(3)}-{d(4)} {r.choice(['ok', 'now', '.'])}", y))
        out.append((f"{r.choice(cue['phone'])}{d(3)}-{d(3)}-{d(4)}.", 1))
        out.append((f"{r.choice(plain)}({d(3)}) {d(3)}-{d(4)}", 1))
        out.append((f"{r.choice(plain)}20{d(2)}-{d(2)}-{d(2)} later", 0))
        out.append((f"{r.choice(plain)}{d(2)}/{d(2)}/19{d(2)} later", 0))
        out.append((f"{r.choice(plain)}{d(2)}.{d(3)}.{d(3)} units", 0))
        out.append((f"{r.choice(bad)}{d(3)}-{d(2)}-{d(4)}-{d(3)}", 0))
        for lead, y in ((r.choice(cue["card"]), 1), (r.choice(bad), 0), (r.choice(plain), 0)):
            s = r.choice("._/")
            out.append((f"{lead}{s.join([d(4), d(4), d(4), d(4)])} end", y))
        for _ in range(3):
            out.append((f"{r.choice(plain)}{r.choice(hold)}{secret()}{r.choice(['', chr(34), ' ok', '.'])}", 1))
            out.append((f"{r.choice(plain)}{r.choice(loose)}{secret()} ok", 0))
            out.append((f"{r.choice(plain + hold)}{slug()} later", 0))
        out.append((f"{r.choice(plain)}{d(r.randint(12, 20))} units", 0))
        out.append((f"{r.choice(plain)}{r.choice(hold)}{d(4)}-{d(2)}-{d(2)}", 0))
        out.append((f"{r.choice(plain)}{d(4)}-{d(2)}-{d(2)}-{d(2)}-{d(2)} later", 0))
        out.append((f"{r.choice(plain)}{r.choice(['A', 'BX', 'ref'])}{d(3)}-{d(4)}-{d(5)} later", 0))
        out.append((f"{r.choice(plain)}{''.join(r.choice(words) for _ in range(r.randint(3, 5)))}{d(1)} later", 0))
        out.append((f"{r.choice(cue['ip'])}{':'.join(hex4() for _ in range(8))} up", 1))
        out.append((f"{r.choice(bad)}{':'.join(d(2) for _ in range(8))} x", 0))
    return out


def _fit_tree(x, g, h):
    """Regression tree of ``DEPTH`` on gradients: nested (feature, cut, left, right) or a leaf value."""

    def leaf(mask):
        return float(g[mask].sum() / (h[mask].sum() + 1.0))

    def split(mask):
        best, total = None, g[mask].sum() ** 2 / (h[mask].sum() + 1.0)
        for f in range(x.shape[1]):
            for cut in np.unique(np.quantile(x[mask, f], np.linspace(0, 1, 17), method="lower"))[:-1]:
                left = mask & (x[:, f] <= cut)
                right = mask & ~left
                gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[right].sum() ** 2 / (h[right].sum() + 1.0) - total
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, float(cut), left, right)
        return best

    def grow(mask, depth):
        s = split(mask) if depth else None
        if s is None or s[0] < 1e-6:
            return leaf(mask)
        return (s[1], s[2], grow(s[3], depth - 1), grow(s[4], depth - 1))

    return grow(np.ones(len(g), bool), DEPTH)


def _run_tree(t, x):
    if not isinstance(t, tuple):
        return np.full(len(x), t)
    return np.where(x[:, t[0]] <= t[1], _run_tree(t[2], x), _run_tree(t[3], x))


class Boosted:
    """Boosted trees with a threshold for each kind; :meth:`column` is their CASE expression."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        fit = np.arange(len(y)) % 3 != 0
        self.trees, score = [], np.zeros(len(y))
        self.bias = float(np.log((y[fit].mean() + 1e-6) / (1 - y[fit].mean() + 1e-6)))
        score += self.bias
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            t = _fit_tree(x[fit], (y - p)[fit], (p * (1 - p))[fit])
            self.trees.append(t)
            score += RATE * _run_tree(t, x)
        # calibrated on the third that was held out: the lowest score of a true one at which precision holds, all of that score
        # or more counted; the threshold lies halfway to what comes below
        self.threshold = []
        for k in range(len(KINDS)):
            mine = ~fit & (x[:, 0] == k)
            s, hit = score[mine], y[mine] > 0
            good = [c for c in np.unique(s[hit]) if hit[s >= c].mean() >= PRECISION]
            below = s[s < good[0]] if good else s
            self.threshold.append(float("inf") if not good else float(good[0] + below.max()) / 2 if len(below) else float(good[0]) - 1.0)

    def column(self, f: Column) -> Column:
        def expr(t):
            return F.lit(t * RATE) if not isinstance(t, tuple) else F.when(f[FEATURES[t[0]]] <= t[1], expr(t[2])).otherwise(expr(t[3]))

        out = F.lit(self.bias)
        for t in self.trees:
            out = out + expr(t)
        return out

    def margin(self, f: Column) -> Column:
        """How far a candidate's score lies above the threshold of its kind."""
        need = F.lit(float("inf"))
        for k, t in enumerate(self.threshold):
            need = F.when(f["kind"] == float(k), F.lit(t)).otherwise(need)
        return self.column(f) - need


_fitted: Boosted | None = None


def model(spark: SparkSession) -> Boosted:
    """The boosted trees, fitted once a process to the generated examples."""
    global _fitted
    if _fitted is None:
        rows = examples()
        df = spark.createDataFrame([(t, y) for t, y in rows], "text string, y int")
        got = (
            df.withColumn("c", candidates(F.col("text")))
            .select("y", F.explode(F.transform("c", lambda x: features(F.col("text"), x))).alias("f"))
            .select("y", "f.*")
            .orderBy(*FEATURES, "y")
            .collect()  # bounded: a few candidates for each generated example
        )
        x = np.array([[r[f] for f in FEATURES] for r in got])
        y = np.array([r["y"] for r in got], float)
        order = np.random.default_rng(0).permutation(len(y))
        _fitted = Boosted(x[order], y[order])
    return _fitted


# --- the operator ------------------------------------------------------------------------


def find(docs: DataFrame, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``body`` (the text, null as empty), ``base`` and ``spans`` (arrays of s, k, e, m by start, then kind)."""
    trees = model(docs.sparkSession)
    t = F.col("__body")
    out = docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__body"))
    out = out.withColumn("base", base_spans(t))
    out = out.withColumn("cand", candidates(t))
    more = F.filter("cand", lambda x: ~F.exists("base", lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"])))
    out = out.withColumn("cand", F.when(F.size("cand") > 0, more).otherwise(F.col("cand")))
    # two steps, so that the trees refer to the features instead of holding them
    judged = F.transform(F.transform("cand", lambda x: F.struct(x.alias("x"), features(t, x).alias("f"))), lambda c: F.struct((-trees.margin(c["f"])).alias("short"), c["x"].alias("x")))
    chosen = F.transform(F.array_sort(F.filter(judged, lambda c: c["short"] <= 0)), lambda c: c["x"])

    def step(acc, x):  # the best-scored first
        return F.when(F.exists(acc, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])), acc).otherwise(F.concat(acc, F.array(x)))

    best = F.aggregate(chosen, _empty(), step)
    out = out.withColumn("added", F.when(F.size("cand") > 0, best).otherwise(_empty()))
    return out.select(*keep, F.col("__body").alias("body"), "base", F.array_sort(F.concat("base", "added")).alias("spans"))


def written(spans_: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(found: DataFrame, keep: tuple = ("doc_id",)) -> DataFrame:
    """Counts and digest of the base spans, and all spans written out."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(*keep, *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS) if name in BASE], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``[KIND]`` (overlapping spans as one, by the first's kind); null stays null."""
    columns = docs.columns
    rest = tuple(c for c in columns if c != text)
    inner = docs.select(F.struct(*[F.col(c) for c in columns]).alias("__row"), F.col(text).alias("__t"))
    found = find(inner, "__t", ("__row",))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def merge(acc, x):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), last["k"].alias("k"), F.greatest(last["e"], x["e"]).alias("e"), last["m"].alias("m"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(last["e"] > x["s"], joined.cast(_SPAN)).otherwise(F.concat(acc, F.array(x)))

    found = found.withColumn("flat", F.aggregate("spans", _empty(), merge))
    piece = lambda x, i: F.concat(
        F.substring("body", F.when(i == 0, F.lit(0)).otherwise(F.get("flat", i - 1)["e"]) + 1, x["s"] - F.when(i == 0, F.lit(0)).otherwise(F.get("flat", i - 1)["e"])),
        F.element_at(names, x["k"] + 1),
    )
    tail = F.substring("body", F.element_at("flat", -1)["e"] + 1, F.length("body"))
    clean = F.when(F.size("flat") == 0, F.col("body")).otherwise(F.concat(F.array_join(F.transform("flat", piece), ""), tail))
    out = found.select("__row", F.when(F.col(f"__row.`{text}`").isNull(), F.lit(None)).otherwise(clean).alias("__clean"))
    return out.select(*[F.col("__clean").alias(c) if c == text else F.col(f"__row.`{c}`").alias(c) for c in columns])
