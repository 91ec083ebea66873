"""Personal data by weak supervision.

Base spans (e-mail, IPv4 address, card and phone number) follow fixed patterns and always count. Looser patterns give
further candidates of these kinds, and of three more: account numbers, United States social security numbers, and
secrets (keys, tokens, passwords). A secret's span is its value: a private key block, a signed web token, a value given
to a name like ``password``, or a run of 16 or more of the characters that encodings use, digits and letters among them.
Nothing in a secret's characters tells it from a checksum, so there the context labeler votes against what has no cue. Three labelers vote for, against or not at all on every candidate and base span: one checks the
shape (check digits, ranges, lengths), one looks parts up in gazetteers, one reads the words around it. Votes are
counted by pattern over the whole corpus; expectation-maximisation on the counts estimates each labeler's reliability
per kind, and a logistic classifier on votes, kind, length and separators is fitted to the resulting probabilities. It
decides on the candidates that base patterns didn't take.

A candidate is reduced to a feature code with a few thousand possible values. The corpus is read once; what reaches the
driver is one count per code, and what goes back is the list of accepted codes. Texts are never shuffled.

Defined cases: a null or empty text has no spans; overlapping candidates of a kind yield to base spans, then to the
earlier and longer one; repeated rows count each; an empty table gives an empty result. Offsets are code points, ends
are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fairground.llm.registry import query
from fairground.llm.rows import keyed, named, same_row
from fairground.session import cut_lineage

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
ACCEPT = 0.9
REACH = 28  # characters of context on the left

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![\w.])[\w.+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}) ?[\w-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}) ?[\w-]{1,63}+){1,4}", re.I),
    "ip": re.compile(r"(?<![\w:])[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7}(?![\w:])"),
    "phone": re.compile(r"(?<![\w.+-])(?:\(0?[0-9]{2,4}\) ?|00?[1-9][0-9]{0,3}[ ./-])[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![\w-]|\.[0-9])"),
    "card": re.compile(r"(?<![\w.-])[0-9]{4}(?:[ ./][0-9]{4}){3}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    "ssn": re.compile(r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
}
# every repetition is possessive or bounded, so that a text without spaces costs what it is long
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*+-----END [A-Z ]{0,40}PRIVATE KEY-----")
_WEB_TOKEN = re.compile(r"(?<![\w-])eyJ[\w-]++\.[\w-]++\.[\w-]++")
_GIVEN = re.compile(r"(?<![a-z0-9])(?:[a-z0-9]{1,20}[_-]){0,3}(?:token|secret|password|passwd|pwd|passphrase|(?:api|access|private)[_-]?key)[\"']? {0,3}[:=] {0,3}[\"']?([^\s\"',;]{8,256})", re.I)
_RUN = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}")
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)
_CUES = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel", "adresse"),
    "ip": ("ip", "address", "host", "server", "adresse", "direcc"),
    "card": ("card", "visa", "master", "amex", "credit", "karte", "tarjeta", "carte", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "whatsapp", "ruf", "handy", "llam", "appel"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "tax id", "taxpayer"),
    "secret": ("token", "secret", "passw", "pwd", "passphrase", "api", "key=", "key:", "key =", "_key", " key ", "private key", "auth", "bearer", "credential"),
}
_DIGESTS = ("sha", "md5", "hash", "checksum", "digest", "commit", "revision", "etag", "uuid", "integrity", "fingerprint")
_AGAINST = ("version", "isbn", "issn", "order", "invoice", "page", "figure", "section", "doi", "serial", "id ", "no. ", "rfc")
_TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io co me tv de fr es it uk us ca eu ch at be nl pl pt se no fi dk cz ru jp cn in br mx ar au nz".split())
_KEY_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "rk_live_", "xoxb-", "xoxp-", "eyJ", "-----BEGIN")
_IBAN_COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MT NL NO PL PT RO SE SI SK TR".split())


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octets(s: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in s.split("."))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        # the run of local characters before the @; a chunk at a time, so that long runs cost what they are long
        start = at
        while start > done:
            low = max(done, start - 256)
            got = len(_LOCAL_END.search(text[low:start]).group()) if _local(text[start - 1]) else 0
            start -= got
            if not got or start > low:
                break
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((0, start, domain.end()))
            done = domain.end()
        else:
            done = max(done, at)
        at = text.find("@", max(at + 1, done))
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _octets(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and _luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


def _local(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "._%+-")


def _shape(kind: str, s: str) -> int:
    digits = _digits(s)
    if kind == "email":
        return 1 if _DOMAIN.fullmatch(s.partition("@")[2]) else 0
    if kind == "ip":
        return (1 if _octets(s) else -1) if "." in s else 1
    if kind == "card":
        return 1 if 13 <= len(digits) <= 19 and _luhn(digits) else -1
    if kind == "phone":
        return (1 if 9 <= len(digits) <= 15 else -1) if s[0] in "+(0" and len(set(digits)) > 2 else -1
    if kind == "ssn":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    if kind == "secret":
        if s.startswith("-----BEGIN"):
            return 1
        part = s[:64]
        mixed = any(c.isdigit() for c in part) and any(c.isalpha() for c in part)
        return (1 if len(s) >= 20 else 0) if mixed and 2 * len(set(part)) >= min(len(part), 20) else -1
    plain = s.replace(" ", "")
    number = int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4]))
    return 1 if number % 97 == 1 else -1


def _listed(kind: str, s: str) -> int:
    if kind == "email":
        return 1 if re.split(r"[^a-z0-9]+", s.lower().rstrip(")]}"))[-1] in _TOP_DOMAINS else -1
    if kind == "ip":
        return -1 if s.startswith(("0.", "127.", "255.")) else 0
    if kind == "card":
        d = _digits(s)
        issued = d[0] == "4" or "51" <= d[:2] <= "55" or "2221" <= d[:4] <= "2720" or d[:2] in ("34", "37", "35", "36", "65") or d[:4] == "6011"
        return 1 if issued else 0
    if kind == "phone":
        return 1 if s.startswith(("+", "00")) else 0
    if kind == "ssn":
        return 0
    if kind == "secret":
        return 1 if s.startswith(_KEY_PREFIXES) else -1 if _UUID.fullmatch(s) or s.count("/") > 2 else 0
    return 1 if s[:2] in _IBAN_COUNTRIES else -1


def _context(kind: str, left: str) -> int:
    left = left.lower()
    if kind == "secret" and any(c in left for c in _DIGESTS):
        return -1
    if any(c in left for c in _CUES[kind]):
        return 1
    return -1 if kind in ("ssn", "secret") or any(c in left for c in _AGAINST) else 0


def feature_code(kind: int, text: str, start: int, end: int) -> int:
    """Kind, three votes, length and number of separators as one small number."""
    s, name = text[start:end], KINDS[kind]
    left = text[max(0, start - REACH) : start] + (s[:REACH] if s.startswith("-----BEGIN") else "")  # a block names itself
    votes = _shape(name, s) + 1, _listed(name, s) + 1, _context(name, left) + 1
    size = min(7, len(s) // 6)
    separators = min(3, sum(c in " ()-./" for c in s[:64]))
    return ((((kind * 3 + votes[0]) * 3 + votes[1]) * 3 + votes[2]) * 8 + size) * 4 + separators


def _decode(codes: np.ndarray) -> tuple[np.ndarray, ...]:
    rest, separators = np.divmod(codes, 4)
    rest, size = np.divmod(rest, 8)
    rest, c = np.divmod(rest, 3)
    rest, b = np.divmod(rest, 3)
    kind, a = np.divmod(rest, 3)
    return kind, a, b, c, size, separators


def secrets(text: str) -> list[tuple[int, int]]:
    """Where keys, tokens and passwords may be; spans can overlap."""
    out = []
    if "-----BEGIN" in text:
        out += [m.span() for m in _KEY_BLOCK.finditer(text)]
    if "eyJ" in text:
        out += [m.span() for m in _WEB_TOKEN.finditer(text)]
    if "=" in text or ":" in text:
        out += [m.span(1) for m in _GIVEN.finditer(text)]
    for m in _RUN.finditer(text):
        if re.search("[0-9]", m.group()) and re.search("[A-Za-z]", m.group()):
            out.append(m.span())
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Loose matches that don't meet a base span of any kind, or an earlier candidate."""
    taken = sorted((s, e) for _, s, e in base)
    out = []
    for name, pattern in _LOOSE.items():
        if name == "iban" and not text.isascii() and not re.search("[A-Z]{2}[0-9]{2}", text):
            continue
        out += [(KINDS.index(name), m.start(), m.end()) for m in pattern.finditer(text)]
    out += [(KINDS.index("secret"), s, e) for s, e in secrets(text)]
    out.sort(key=lambda x: (x[1], -x[2], x[0]))
    kept, last, b = [], 0, 0
    for k, s, e in out:
        while b < len(taken) and taken[b][1] <= s:
            b += 1
        if s >= last and not (b < len(taken) and taken[b][0] < e):
            kept.append((k, s, e))
            last = e
    return kept


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32())]))
    for batch in batches:
        found, loose = [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            base = base_spans(text)
            more = candidates(text, base)
            found.append([(k, s, e, feature_code(k, text, s, e)) for k, s, e in sorted(base)])
            loose.append([(k, s, e, feature_code(k, text, s, e)) for k, s, e in sorted(more)])
        as_structs = lambda rows: pa.array([[dict(zip(("kind", "start", "end", "code"), x)) for x in r] for r in rows], span)
        yield pa.RecordBatch.from_arrays([batch.column(0), as_structs(found), as_structs(loose)], names=["key", "base", "loose"])


def reliabilities(kind: np.ndarray, votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability of each vote pattern (rows; votes 0, 1, 2 of each labeler) by expectation-maximisation per kind.

    Labelers are taken as independent given the truth. It starts from the balance of votes and leans, by a few
    pseudo-counts, to labelers that are right more often than not.
    """
    p = np.full(len(n), 0.5)
    for k in np.unique(kind):
        own = kind == k
        v, c = votes[own], n[own].astype(float)
        q = np.clip(0.5 + (v - 1).sum(axis=1) / (2 * v.shape[1] + 1), 0.05, 0.95)
        for _ in range(rounds):
            logs = np.zeros((len(v), 2))
            for truth in (0, 1):
                w = c * (q if truth else 1 - q)
                logs[:, truth] += np.log((w.sum() + 1) / (c.sum() + 2))
                for j in range(v.shape[1]):
                    lean = np.array([4.0, 2.0, 1.0] if not truth else [1.0, 2.0, 4.0])
                    counts = np.bincount(v[:, j], weights=w, minlength=3) + lean
                    logs[:, truth] += np.log(counts / counts.sum())[v[:, j]]
            q = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -40, 40)))
        p[own] = q
    return p


def _features(codes: np.ndarray) -> np.ndarray:
    kind, a, b, c, size, separators = _decode(codes)
    blocks = [np.eye(len(KINDS))[kind], np.eye(3)[a], np.eye(3)[b], np.eye(3)[c], np.eye(8)[size], np.eye(4)[separators]]
    return np.hstack(blocks)


def fit_classifier(codes: np.ndarray, n: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights of a logistic classifier on the codes' features, fitted to the estimated probabilities."""
    kind, a, b, c, _, _ = _decode(codes)
    p = reliabilities(kind, np.stack([a, b, c], axis=1), n)
    x, weight = _features(codes), np.log1p(n)  # a frequent pattern shall not drown the rare ones
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        guess = 1 / (1 + np.exp(-x @ w))
        w -= 4.0 * ((x * ((guess - p) * weight)[:, None]).sum(axis=0) / weight.sum() + 1e-4 * w)
    return w


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """Per row of ``docs``: key, ``base`` and ``spans`` (arrays of ``kind, start, end``; spans hold the base ones too)."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    span = "array<struct<kind:int,start:int,end:int,code:int>>"
    found = cut_lineage(rows.mapInArrow(_find, f"key {dict(rows.dtypes)['key']}, base {span}, loose {span}"))
    counts = found.select(F.explode(F.concat("base", "loose")).alias("s")).groupBy("s.code").agg(F.count("*").alias("n"))
    seen = counts.toPandas().sort_values("code")  # one row per feature code: at most 7 * 27 * 32
    codes = seen["code"].to_numpy(dtype=np.int64)
    accepted: list[int] = []
    if len(codes):
        w = fit_classifier(codes, seen["n"].to_numpy())
        accepted = codes[1 / (1 + np.exp(-_features(codes) @ w)) >= accept].tolist()
    known = F.array(*map(F.lit, accepted)) if accepted else F.array().cast("array<int>")
    more = F.filter("loose", lambda s: F.array_contains(known, s["code"]))
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(F.col("key").alias(key), plain(F.col("base")).alias("base"), F.array_sort(plain(F.concat("base", more))).alias("spans"))


def spelled(spans: str):
    """``kind:start:end`` of all spans, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; rows meet their spans by key and text hash."""
    rows = docs.select(F.struct(named(key).alias("k"), F.xxhash64(named(text)).alias("t")).alias("key"), named(text).alias("text"))
    spans = find_personal_data(rows, "key", "text").dropDuplicates(["key"]).select("key.k", "key.t", "spans")
    spans = spans.withColumnsRenamed({"k": "v_k", "t": "v_t"}).where("size(spans) > 0")
    joined = keyed(docs, key, text).join(spans, same_row(), "left")
    # spans in order of position; one that begins inside an earlier one is dropped
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    body = F.col("row")[text]
    step = lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
        F.concat(acc["out"], F.substring(body, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), name(s["kind"]), F.lit("]")).alias("out"),
        s["end"].alias("at"),
    ))
    masked = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))))
    cut = F.when(F.col("spans").isNotNull(), masked).otherwise(body)
    return joined.withColumn("row", F.col("row").withField(f"`{text}`", cut)).select("row.*")


@query("op6_pii")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of every document."""
    found = find_personal_data(spark.read.parquet(f"{sf}/documents.parquet"))
    number = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(number, F.lit(i)))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(spelled("base"), 256).alias("base_sha256"), spelled("spans").alias("spans"))
