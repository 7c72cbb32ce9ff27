"""Secret scans: a random forest decides which candidates are secrets.

*Candidates* are runs of 16 or more characters of keys and tokens, values (of 4 characters or more) assigned to a name that ends in or goes on from a word such as ``password`` or
``api_key``, and blocks of private keys between their BEGIN and END lines (of ``PEM`` characters at most; a longer one gives its lines as runs). *Features* of a candidate are its length, how likely its characters follow one another in words,
how much of it words of a dictionary cover, its make-up, whether it lies in a path, address or URL, and the
words next to it. *Forest*: trees grown on labelled findings (a table of before, candidate, after, label) decide.

The findings of the registered query come from a rule, :func:`labelled_findings`: credentials in usual notations against checksums,
commit ids, identifiers, numbers, addresses, paths and placeholders. Fitting takes at most ``sample_rows`` findings to the driver.
Scanning is one pass over whole texts without a shuffle; the forest (a fixed number of trees of bounded depth) is broadcast.

Cases: a null or empty text has no finding. Repeated rows are scanned one by one, equal findings of a text are each reported. Candidates never
overlap; where a run holds the name of an assignment, the assigned value is taken. Very long texts are searched whole. With no labelled finding every score is 0 and nothing is a secret.
Other columns are kept by :func:`redact` and ignored by :func:`scan`.
"""

from __future__ import annotations

import base64
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import prepare
from tidemill.tables import table

SAMPLE_ROWS = 20_000
FINDINGS = 6000
TREES = 48
DEPTH = 12
THRESHOLD = 0.5
AROUND = 48  # characters on either side whose words count

PEM = 20_000
_NAME = r"(?i:(?:password|passwd|pwd|secret|token|api_?key|access_?key|auth)\w{0,20})"
_VALUE = r"""["']?\s?[:=]=?\s?["']?(?P<value>[^\s"'<>,;|]{4,})"""
_BLOCK = rf"(?P<block>-----BEGIN [A-Z0-9 ]{{0,30}}PRIVATE KEY-----[A-Za-z0-9+/=\s:,-]{{0,{PEM}}}?-----END [A-Z0-9 ]{{0,30}}PRIVATE KEY-----)"
_ASSIGNED = re.compile(_NAME + _VALUE)
_CANDIDATE = re.compile(rf"{_BLOCK}|{_NAME}{_VALUE}|(?P<run>[A-Za-z0-9][A-Za-z0-9+/_.~-]{{15,}}={{0,2}})")
_WORD = re.compile(r"[A-Za-z]+")
#: Names that go with credentials, and names that go with other long tokens.
_SECRET_WORDS = frozenset("token secret password passwd pwd key apikey auth authorization bearer credential credentials private access login signing".split())
_OTHER_WORDS = frozenset("commit sha md5 sha1 sha256 checksum digest hash uuid guid id revision etag file path url http https www version image order invoice phone mail email isbn card".split())
#: A dictionary for coverage, common English and programming words.
DICTIONARY = tuple("""
the and for with that this from have not are was all can will your more about time each which their there other when them these some would into has two could first than
make been call who now find long down day did get come made may part over new sound take only little work know place year live back give most very after thing name good sentence
man think say great where help through much before line right too mean old any same tell boy follow came want show also around form three small set put end does another well large must big even such because turn here why ask
user admin test example sample data file path type value index count list item page view main init config build server client host port local remote public static final class object string number array table column
query result error message default option state status update create delete select insert import export module package version release module service request response session cookie header content length format image button
""".split())
_CLASSES = 40


def _class_table() -> np.ndarray:
    """Byte to its class: letters, capital, digit, then each kind of joiner."""
    out = np.full(256, 39, np.uint8)
    for i in range(26):
        out[97 + i] = i
        out[65 + i] = 26
    out[48:58] = 27
    for i, c in enumerate(b"+/=_.~-"):
        out[c] = 28 + i
    return out


_TABLE = _class_table()


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Character spans of candidates; assigned values of punctuation only are left out."""
    at = 0
    while m := _CANDIDATE.search(text, at):
        name_end = m.start() + len((m.group("run") or "").rstrip("="))
        if m.group("run") and text[name_end : name_end + 3].lstrip("\"' ").startswith((":", "=")):
            inner = _ASSIGNED.search(text, m.start(), m.end() + 256)
            if inner and inner.start() < name_end:
                m = _ASSIGNED.match(text, inner.start())  # its value isn't cut off
        kind = m.lastgroup
        start, end = m.span(kind)
        at = m.end()
        if kind == "block":
            yield start, end
            continue
        body = text[start:end].rstrip(".,:;!?#$%&*)]}")
        if len(body) >= 4 and any(c.isalnum() for c in body):
            yield start, start + len(body)


class Words:
    """Character transitions and a dictionary, learned from words that are no secrets."""

    def __init__(self, words: list[str], dictionary: tuple[str, ...] = DICTIONARY) -> None:
        counts = np.full((_CLASSES, _CLASSES), 0.5)
        for w in [*dictionary, *words]:
            c = _TABLE[np.frombuffer(w.encode("utf-8", "replace"), np.uint8)]
            np.add.at(counts, (c[:-1], c[1:]), 1.0)
        self.log = np.log(counts / counts.sum(1, keepdims=True))
        self.dictionary = frozenset(w for w in dictionary if len(w) >= 3)
        self.longest = max(map(len, self.dictionary), default=0)

    def likely(self, raw: bytes) -> float:
        c = _TABLE[np.frombuffer(raw, np.uint8)]
        return float(self.log[c[:-1], c[1:]].mean()) if len(c) > 1 else 0.0

    def covered(self, text: str) -> float:
        """Part of the characters that the longest dictionary words, taken from the left, cover."""
        low, at, got = text.lower(), 0, 0
        while at < len(low):
            size = next((n for n in range(min(self.longest, len(low) - at), 2, -1) if low[at : at + n] in self.dictionary), 0)
            got += size
            at += size or 1
        return got / max(1, len(low))


def features(before: str, body: str, after: str, words: Words) -> list[float]:
    raw = body.encode("utf-8", "replace")
    n = len(body)
    counts = Counter(body)
    digits = sum(c.isdigit() for c in body)
    upper = sum(c.isupper() for c in body)
    lower = sum(c.islower() for c in body)
    c = _TABLE[np.frombuffer(raw, np.uint8)]
    kind = np.where(c < 26, 0, np.where(c == 26, 1, np.where(c == 27, 2, 3)))
    near_before, near_after = [w.lower() for w in _WORD.findall(before)[-3:]], [w.lower() for w in _WORD.findall(after)[:2]]
    last = before.rstrip("\"' ")
    return [
        math.log(n),
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        len(counts) / n,
        words.likely(raw),
        words.covered(body),
        digits / n,
        upper / n,
        lower / n,
        float((kind[1:] != kind[:-1]).mean()) if n > 1 else 0.0,
        float(all(x in "0123456789abcdefABCDEF" for x in body)),
        float(n in (32, 40, 64) or n % 4 == 0),
        float(body.isdigit()),
        sum(body.count(x) for x in "/\\") / n,
        body.count(".") / n,
        (body.count("-") + body.count("_")) / n,
        float(before.endswith(("/", "\\", "@", "."))),
        float("://" in before[-24:] or "://" in body or "www." in before[-8:]),
        float(bool(re.search(r"\.[A-Za-z]{2,4}$", body))),
        float(last.endswith(("=", ":"))),
        float(before.endswith(("'", '"'))),
        float(any(w in _SECRET_WORDS or any(s in w for s in ("secret", "token", "passw", "apikey")) for w in near_before)),
        float(any(w in _OTHER_WORDS for w in near_before + near_after)),
        float(after.startswith("@")),
        max((len(m) for m in re.findall(r"[A-Za-z]+", body)), default=0) / n,
        float("PRIVATE KEY-" in body),
        sum(c in "aeiouyAEIOUY" for c in body) / max(1, lower + upper),
    ]


@dataclass
class Forest:
    """Trees in arrays: feature (-1 at a leaf), threshold, left child (the right one follows it), share of secrets."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray

    @classmethod
    def grow(cls, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> Forest:
        rng = np.random.default_rng(seed)
        grown = [_tree(x, y, rng, depth) for _ in range(trees)]
        size = max(len(t) for t in grown)
        parts = np.zeros((4, trees, size))
        for i, t in enumerate(grown):
            parts[:, i, : len(t)] = np.array(t).T
        return cls(parts[0].astype(np.int64), parts[1], parts[2].astype(np.int64), parts[3])

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, t, c, v in zip(self.feature, self.threshold, self.child, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while True:
                inner = f[at] >= 0
                if not inner.any():
                    break
                step = c[at] + (x[rows, np.maximum(f[at], 0)] > t[at])
                at = np.where(inner, step, at)
            total += v[at]
        return total / max(1, len(self.feature))


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> list[list[float]]:
    """Rows of (feature, threshold, left child, value), grown on a bootstrap sample by Gini impurity."""
    n, d = x.shape
    nodes: list[list[float]] = [[-1, 0, 0, 0]]
    todo = [(0, rng.integers(0, n, n), 0)]
    while todo:
        at, rows, level = todo.pop()
        mean = y[rows].mean()
        nodes[at][3] = mean
        if level >= depth or len(rows) < 4 or mean in (0.0, 1.0):
            continue
        best = (mean * (1 - mean) * len(rows) - 1e-9, -1, 0.0)
        for f in rng.permutation(d)[: max(2, int(math.sqrt(d)) + 1)]:
            order = np.argsort(x[rows, f], kind="stable")
            v, s = x[rows[order], f], np.cumsum(y[rows[order]])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            left = cut + 1.0
            p, q = s[cut] / left, (s[-1] - s[cut]) / (len(rows) - left)
            impurity = left * p * (1 - p) + (len(rows) - left) * q * (1 - q)
            k = int(np.argmin(impurity))
            if impurity[k] < best[0]:
                best = (impurity[k], int(f), v[cut[k]])
        if best[1] < 0:
            continue
        right = x[rows, best[1]] > best[2]
        nodes[at][:3] = [best[1], best[2], len(nodes)]
        todo += [(len(nodes), rows[~right], level + 1), (len(nodes) + 1, rows[right], level + 1)]
        nodes += [[-1, 0, 0, 0], [-1, 0, 0, 0]]
    return nodes


def labelled_findings(n: int = FINDINGS, seed: int = 3) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, label), half of them secrets, by a rule from a seed."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[int(rng.integers(len(options)))]
    hexa = lambda k: rng.bytes(k // 2).hex()
    chars = lambda k, alphabet: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: pick(*DICTIONARY)
    phrase = lambda k: " ".join(chars(int(rng.integers(2, 11)), alnum[:26]) if rng.random() < 0.5 else word() for _ in range(k))
    b64 = lambda k: base64.b64encode(rng.bytes(k)).decode()

    letters = alnum[:52]
    syllable = lambda: chars(1, "bcdfghklmnprstvw") + chars(1, "aeiou") + pick("", "", chars(1, "nrstl"))

    def secret() -> tuple[str, str, str]:
        if rng.random() < 0.08:
            kind = pick("", "RSA ", "EC ", "OPENSSH ")
            lines = "\n".join(b64(48) for _ in range(int(rng.integers(1, 8))))
            return pick("", "key: ", "\n"), f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n-----END {kind}PRIVATE KEY-----", ""
        if rng.random() < 0.12:
            value = chars(int(rng.integers(20, 41)), pick(letters, letters[:26], letters[26:]))
            return pick("key ", "the token is ", "secret ", 'api_key = "', "access_key: ", "bearer ", ""), value, ""
        if rng.random() < 0.12:
            value = chars(2, letters[:26]).title() + chars(int(rng.integers(2, 5)), alnum) + chars(1, "0123456789") + chars(int(rng.integers(0, 3)), "!@$%*+?_")
            return pick("password: ", "passwd=", "pwd = ", 'password="', "my_password: ", "DB_PASSWORD="), value.rstrip("!$%*?"), ""
        value = pick(lambda: hexa(pick(32, 40, 64)), lambda: hexa(40), lambda: b64(pick(18, 24, 32, 48)), lambda: chars(int(rng.integers(16, 48)), alnum), lambda: pick("ghp_", "sk_live_", "xoxb-", "key-", "AKIA") + chars(int(rng.integers(16, 37)), alnum), lambda: chars(int(rng.integers(8, 16)), alnum + "!#$%&*+?@_"), lambda: f"eyJ{b64(18).rstrip('=')}.eyJ{b64(30).rstrip('=')}.{b64(24).rstrip('=')}")()
        name = pick("token", "secret", "password", "api_key", "apikey", "access_key", "secret_key", "auth_token", "private_key", "passwd")
        opening, closing = pick((f'{name} = "', '"'), (f"{name}='", "'"), (f"{name}: ", ""), (f'"{name}": "', '",'), (f"{name}=", ""), ("authorization: bearer ", ""), (f"export {name}=", ""))
        return opening, value, closing

    def other() -> tuple[str, str, str]:
        return pick(
            lambda: (pick("commit ", "sha1: ", "revision ", "merge "), hexa(40), ""),
            lambda: (pick("md5 ", "checksum: ", "sha256=", "digest ", "etag: "), hexa(pick(32, 64)), pick("", "  file.bin")),
            lambda: (pick("id=", "uuid: ", "request ", ""), str(uuid.UUID(bytes=rng.bytes(16))), ""),
            lambda: (pick("card ", "order ", "", "phone "), chars(int(rng.integers(16, 20)), "0123456789"), ""),
            lambda: (word() + "." + chars(2, "0123456789") + "@", f"mail{rng.integers(99)}.{word()}.{pick('com', 'org', 'net')}", ""),
            lambda: ("", f"{word()}.{word()}{rng.integers(99)}", f"@{word()}.com"),
            lambda: (pick("/", "src/", "https://", "see "), "/".join(word() for _ in range(4)) + f"/{word()}{rng.integers(99)}.{pick('html', 'py', 'png')}", ""),
            lambda: (pick("", "call ", "def "), pick("_", "-", "").join(pick(str, str.title)(word()) for _ in range(4)) + str(rng.integers(999)), pick("(", "", " =")),
            lambda: (pick("token = ", "password: ", "api_key=", 'secret = "'), pick("your_token_here", "xxxxxxxxxxxxxxxx", "changeme123456", "example_password_1", "REPLACE_WITH_KEY_01", "placeholder000000", "<password>", "os.environ['KEY']", "none_required_000"), ""),
            lambda: ("version ", f"{word()}-{rng.integers(9)}.{rng.integers(99)}.{rng.integers(999)}-{word()}", ""),
            lambda: ("", f"20{rng.integers(10, 30)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}T{rng.integers(10, 24)}:{rng.integers(10, 60)}:{rng.integers(10, 60)}Z".replace(":", "-"), ""),
            lambda: (pick("password", "the token", "a key") + pick(": ", " = "), word() + pick("-", "_", ".") + word(), ""),
            lambda: (pick("password: ", "token: ", "secret = ", "auth: ", "token=", "passwords: "), pick(word, word, lambda: pick("none", "null", "true", "false", "string", "basic", "required", "optional", "your", "self.token", "get_token()", "request.token", "args.password"))(), pick("", " is", " and")),
            lambda: (word() + " ", "".join(syllable() for _ in range(int(rng.integers(7, 12)))), pick("", ".", " " + word())),
            lambda: (pick("", "def ", "class ", "call "), pick("", "_", "-", ".").join(pick(str, str.title)(pick(word, syllable)()) for _ in range(int(rng.integers(4, 7)))), pick("", "(", " =")),
            lambda: (pick("see ", "in ", "/", "./"), "/".join(pick(word, syllable)() for _ in range(int(rng.integers(4, 7)))) + pick("", "/", ".txt", ".py"), ""),
            lambda: (word() + " ", "".join(pick(*DICTIONARY[:80]) for _ in range(5)) + str(rng.integers(9)), ""),
        )()

    out = []
    for i in range(n):
        label = i % 2
        opening, value, closing = secret() if label else other()
        left, right = phrase(int(rng.integers(0, 6))), phrase(int(rng.integers(0, 4)))
        noise = pick("", "", "", "###", "!!", ",", ".", "$$$", " |")
        row = (f"{left} {opening}", value, f"{closing}{noise} {right}")
        if rng.random() < 0.1:
            row = (row[0].upper(), row[1].upper(), row[2].upper())
        out.append((row[0][-AROUND:], row[1], row[2][:AROUND], label))
    return out


@dataclass
class Model:
    forest: Forest | None
    words: Words

    def judge(self, found: list[tuple[str, str, str]]) -> np.ndarray:
        if not found or self.forest is None:
            return np.zeros(len(found))
        return self.forest.score(np.array([features(*f, self.words) for f in found]))


def fit(findings: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """A forest from at most ``sample_rows`` labelled findings (before, candidate, after, label), in order of a hash."""
    rows = findings.where("candidate is not null and label is not null").selectExpr("coalesce(before, '') as b", "candidate as c", "coalesce(after, '') as a", "cast(label as int) as y")
    got = rows.orderBy(F.xxhash64("b", "c", "a"), "y").limit(sample_rows).collect()
    innocent = [w for b, c, a, y in got for w in [*_WORD.findall(b), *_WORD.findall(a), *([] if y else _WORD.findall(c))] if len(w) > 1]
    words = Words(innocent)
    if not got:
        return Model(None, words)
    x = np.array([features(b, c, a, words) for b, c, a, _ in got])
    return Model(Forest.grow(x, np.array([y for *_, y in got], float)), words)


def own_model(spark: SparkSession, n: int = FINDINGS) -> Model:
    """The forest of the findings that the rule gives."""
    columns = list(zip(*labelled_findings(n), strict=True))
    arrow = pa.table(dict(zip(("before", "candidate", "after", "label"), map(list, columns), strict=True)))
    return fit(spark.createDataFrame(arrow))


def _found(texts: list[str | None], model: Model) -> tuple[list[int], list[tuple[int, int]], list[tuple[str, str, str]], np.ndarray]:
    rows, spans, around = [], [], []
    for row, text in enumerate(texts):
        for start, end in candidates(text) if text else ():
            rows.append(row)
            spans.append((start, end))
            around.append((text[max(0, start - AROUND) : start], text[start:end], text[end : end + AROUND]))
    return rows, spans, around, model.judge(around)


def scan(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, char_start, char_end, candidate, score, is_secret of every candidate."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, spans, around, score = _found(batch.column(1).to_pylist(), shared.value)
            if rows:
                columns = [batch.column(0).take(pa.array(rows)), pa.array([s for s, _ in spans], pa.int64()), pa.array([e for _, e in spans], pa.int64()), pa.array([a[1] for a in around], pa.string()), pa.array(score), pa.array(score >= threshold)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "char_start", "char_end", "candidate", "score", "is_secret"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, char_start long, char_end long, candidate string, score double, is_secret boolean")


def redact(docs: DataFrame, model: Model, threshold: float = THRESHOLD, mark: str = "<secret>") -> DataFrame:
    """The rows with secrets in ``text`` replaced; ``n_chars``, if there, follows in the rows that change."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            rows, spans, _, score = _found(texts, shared.value)
            by_row: dict[int, list[tuple[int, int]]] = {}
            for row, span, s in zip(rows, spans, score, strict=True):
                if s >= threshold:
                    by_row.setdefault(row, []).append(span)
            for row, found in by_row.items():
                parts, done = [], 0
                for start, end in found:
                    parts += [texts[row][done:start], mark]
                    done = end
                texts[row] = "".join([*parts, texts[row][done:]])
            columns = list(batch.columns)
            if by_row:
                columns[at] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    k = names.index("n_chars")
                    counts = batch.column(k).to_pylist()
                    for row in by_row:
                        counts[row] = len(texts[row])
                    columns[k] = pa.array(counts, batch.column(k).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with the forest's score and decision."""
    return scan(table(spark, sf_dir, "documents"), own_model(spark))
