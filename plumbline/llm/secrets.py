"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are strings in the published shape of a key, whole blocks of private keys, passwords in
urls, long tokens that mix character classes, values assigned to a name such as ``password``, values
that mix letters and digits after any other name, and what "the password is". Each becomes a row of
features: length, character transitions, dictionary coverage, what kind of path it stands in, and the
words beside it. A forest of decision trees, grown here from labelled findings, gives the share of
trees that call it a secret. Dictionary and running text of the findings are words of a public
tokenizer's vocabulary, of which the dictionary knows four in five. All steps take time in proportion
to the text.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import map_columns

#: A url with a password is a candidate by itself, not the value of a name.
_WITH_PASSWORD = r"[A-Za-z][A-Za-z0-9+.\-]{0,30}://[^\s/:@\"'<>]*:[^\s/@\"'<>]+@"
#: Published shapes of keys and tokens.
SHAPES = {
    "aws_key_id": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "github_token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "google_key": r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_\-]{35}(?![A-Za-z0-9_\-])",
    "slack_token": r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9\-]{10,}",
    "stripe_key": r"(?<![A-Za-z0-9])[rs]k_(?:live|test)_[A-Za-z0-9]{16,}",
    "jwt": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
    "private_key": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?s:(?:(?!-----BEGIN ).)*?)-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
    r"|(?:[ \t]*\r?\n[ \t]*(?:[A-Za-z\-]+: [^\n]*|[A-Za-z0-9+/=]{16,}[ \t]*(?=\r?\n|\Z)|[A-Za-z0-9+/]*=+[ \t]*(?=\r?\n|\Z)|(?=\r?\n)))*)",
    "url_password": r"://[^\s/:@\"'<>]*:(?P<in_url>[^\s/@\"'<>]{3,})@",
    "assigned": r"(?i:pass(?:word|wd|phrase)?|pwd|secret|token|key|credential)s?(?:[_\-][A-Za-z0-9_\-]{0,32})?"
    rf"[\"']?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}[\"']?(?!{_WITH_PASSWORD})(?P<value>[^\s\"'<>,;]{{8,}})",
    "spoken": r"(?i:password|passphrase|passcode|passwd|pwd|secret|token|api key)\s{1,3}(?i:is|was)\s{0,3}:?\s{1,3}[\"'`]?"
    r"(?=[^\s\"'`<>,;]{0,64}[0-9!@#$%^&*_])(?P<said>[^\s\"'`<>,;]{6,})",
    "valued": rf"(?<=[A-Za-z0-9_\"'\s][:=])[ \t]{{0,3}}[\"']?(?!{_WITH_PASSWORD}|//)"
    r"(?=[^\s\"'<>,;]{0,256}[0-9])(?=[^\s\"'<>,;]{0,256}[A-Za-z])(?P<given>[^\s\"'<>,;]{12,})",
    "long_token": r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{20,}={0,2}(?![A-Za-z0-9+/_\-])",
}
#: The part of a candidate that is the value.
INNER = {"url_password": "in_url", "assigned": "value", "spoken": "said", "valued": "given"}
SCAN = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SHAPES.items()))

#: Words that make a candidate likelier, and less likely, to be a secret.
FOR = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "credential", "login", "bearer", "private")
AGAINST = ("sha", "sha1", "sha256", "md5", "checksum", "digest", "hash", "commit", "revision", "uuid", "guid", "id", "version", "example", "integrity", "etag", "isbn", "build")
_CLASS = bytes(
    0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 for c in range(256)
)
_VOWEL = bytes(ord("v") if c in b"aeiouyAEIOUY" else ord("c") if chr(c).isalpha() and c < 128 else ord("-") for c in range(256))
FEATURES = (
    "length", "entropy", "transitions", "digits", "uppers", "others", "hex", "vowel_runs", "coverage", "slashes", "dots",
    "dashes", "in_url", "word_for", "word_against", "assigned", "shaped", "url_password", "spoken",
)


@lru_cache(maxsize=4)
def words_of(vocabulary: str) -> tuple[str, ...]:
    """Lower-case words of four letters or more in a rank file (base64 and rank a line): tokens with a space before them."""
    with open(vocabulary, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    return tuple(t[1:].decode() for t in tokens if re.fullmatch(rb" [a-z]{4,}", t))


@lru_cache(maxsize=4)
def dictionary(vocabulary: str) -> ahocorasick.Automaton:
    """Four in five of the words; coverage is the share of a candidate's characters inside them, the longest first."""
    found = ahocorasick.Automaton()
    for word in words_of(vocabulary):
        if zlib.crc32(word.encode()) % 5:
            found.add_word(word, len(word))
    found.make_automaton()
    return found


def features(kind: str, value: str, before: str, after: str, vocabulary: str) -> list[float]:
    """One row of FEATURES for a candidate and its surroundings (some 48 characters on either side)."""
    raw = value.encode("utf-8", "replace")
    n = max(len(raw), 1)
    classes = raw.translate(_CLASS)
    counts = [raw.count(bytes([c])) for c in set(raw)]
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    changes = sum(a != b for a, b in zip(classes, classes[1:])) / max(n - 1, 1)
    lower = value.lower()
    covered = sum(length for _, length in dictionary(vocabulary).iter_long(lower)) / n
    vowels = raw.translate(_VOWEL).count(b"vc") / n
    near = re.findall(r"[a-z0-9_]+", before.lower()[-48:])[-4:]
    around = near + re.findall(r"[a-z0-9_]+", after.lower())[:2]
    for_it = any(w.strip("_").rstrip("s") in FOR or w.endswith(("key", "_token", "_secret", "password")) for w in around)
    against = any(w.strip("_") in AGAINST or w.endswith(("_id", "_hash")) for w in around)
    return [
        n, entropy, changes, classes.count(2) / n, classes.count(1) / n, classes.count(3) / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F\-]+", value))), vowels, covered, value.count("/"), value.count("."),
        value.count("-") + value.count("_"), float("://" in before[-48:] or before[-1:] in "/\\" and before != ""),
        float(for_it), float(against), float(kind == "assigned"), float(kind not in ("assigned", "valued", "long_token", "url_password", "spoken")),
        float(kind == "url_password"), float(kind == "spoken"),
    ]


def _families(rng: np.random.Generator, words: tuple[str, ...]) -> dict[str, tuple[int, Callable[[], tuple[str, str, str]]]]:
    """By name: (label, a maker of what stands before a value, the value, and what stands after it)."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alnum, hexes, marks = lower + upper + digits, digits + "abcdef", "!@#%^*-_$"
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    of = lambda alphabet, a, b=0: "".join(pick(alphabet) for _ in range(int(rng.integers(a, (b or a) + 1))))
    word = lambda: pick(words)
    mixed = lambda a, b, more="": of(alnum + more, a, b) + pick(digits) + pick(upper)
    equals = lambda: pick(["=", " = ", ": ", ' = "', '="', " = '", ":", ' := "'])
    named = lambda *tails: pick(["", word() + "_", word().upper() + "_", word() + "-", word().capitalize()]) + pick(tails)
    key = lambda: named("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "Key", "PASSWORD", "SECRET_KEY", "client_secret", "encryption_key", "AccountKey", "credential", "passphrase") + equals()
    plain = lambda: pick([word(), word() + "_" + word(), word().upper(), word() + word().capitalize()]) + equals()
    about = lambda: pick(["", "commit ", "sha256:", "md5 ", "checksum ", "digest: ", "hash ", "etag ", "build ", "version ", "revision ", "id ", word() + " ", word() + "="])
    scheme = lambda: pick(["postgres", "mysql", "https", "redis", "mongodb+srv", "amqp", "ftp"]) + "://"
    host = lambda: "@" + pick(["db", "localhost", word() + ".example.com", "10.0.0.5:5432"]) + "/" + word()
    block = lambda: "\n".join(of(alnum + "+/", 64) for _ in range(int(rng.integers(1, 6)))) + "\n" + of(alnum + "+/", 20, 60)
    secret = {
        "cloud key id": lambda: (pick(["", key()]), pick(["AKIA", "ASIA"]) + of(upper + digits, 16), ""),
        "code host token": lambda: (pick(["", key()]), f"gh{pick('pousr')}_" + of(alnum, 36), ""),
        "search key": lambda: (pick(["", key()]), "AIza" + of(alnum + "-_", 35), ""),
        "payment key": lambda: (pick(["", key()]), pick(["sk", "rk"]) + "_live_" + of(alnum, 24), ""),
        "chat token": lambda: (pick(["", key()]), "xoxb-" + of(digits, 12) + "-" + of(alnum, 24), ""),
        "web token": lambda: (pick(["", "Bearer ", key()]), "eyJ" + of(alnum, 20) + "." + of(alnum + "-_", 40) + "." + of(alnum + "-_", 43), ""),
        "key block": lambda: ("", "-----BEGIN {0}PRIVATE KEY-----\n{1}\n-----END {0}PRIVATE KEY-----".format(pick(["RSA ", "EC ", "", "OPENSSH "]), block()), ""),
        "hex after a name": lambda: (key(), of(hexes, 24, 64), ""),
        "letters and digits after a name": lambda: (key(), mixed(8, 40), ""),
        "marks after a name": lambda: (key(), mixed(6, 24, marks), ""),
        "base64 after a name": lambda: (key(), mixed(38, 84, "+/") + pick(["", "=", "=="]), ""),
        "letters after a name": lambda: (key(), of(lower + upper, 14, 40), ""),
        "words with digits after a name": lambda: (named("password", "passwd", "pwd", "PASSWORD") + equals(), word().capitalize() + pick(marks) + of(digits, 2, 4) + pick(["", "!", "#"]), ""),
        "password in a url": lambda: (scheme() + pick(["app", "admin", "root", "", word()]) + ":", pick([lambda: mixed(6, 24), lambda: mixed(6, 20, "!$%^*-_"), lambda: word() + of(digits, 3)])(), host()),
        "after a name of access": lambda: (named("auth", "DB_PASS", "signing", "webhook", "salt", "bearer", "login", "authorization") + equals(), mixed(18, 60, pick(["", "+/", "!#%^*-_"])), ""),
        "bare token": lambda: (pick(["Bearer ", "secret ", "auth key ", "token ", "private key ", "x-api-key "]), mixed(30, 62, pick(["", "+/", "-_"])), ""),
        "spoken": lambda: (pick(["the ", "your ", "my ", word() + " "]) + pick(["password", "passphrase", "token", "secret", "pwd"]) + pick([" is ", " is: ", " was "]), pick([lambda: mixed(5, 16), lambda: word() + of(digits, 2, 4) + pick(["", "!"]), lambda: mixed(6, 14, marks)])(), pick(["", " ."])),
    }
    other = {
        "digest": lambda: (about(), of(hexes, pick([32, 40, 64])), ""),
        "short digest": lambda: (about(), of(hexes, 20, 48), ""),
        "uuid": lambda: (pick(["id ", "uuid=", "guid: ", "", word() + "="]), "-".join(of(hexes, k) for k in (8, 4, 4, 4, 12)), ""),
        "identifier": lambda: (pick(["", "the ", word() + " "]), "_".join(word() for _ in range(int(rng.integers(3, 6)))) + "_" + of(digits, 1, 3), ""),
        "path": lambda: (pick(["https://", "/", "src/", "../"]), "/".join([*(word() for _ in range(4)), of(digits, 4)]), ""),
        "number": lambda: (pick(["", "no. ", word() + " "]), of(digits, 20, 30), ""),
        "slug": lambda: (pick(["/", "page ", ""]), "-".join(word() for _ in range(int(rng.integers(4, 7)))) + "-" + of(digits, 2, 4), ""),
        "placeholder": lambda: (key(), pick([lambda: "<" + word() + ">", lambda: "your_" + word() + "_here", lambda: "x" * int(rng.integers(8, 20)), lambda: "${" + word().upper() + "_" + word().upper() + "}", lambda: "changeme_" + word(), lambda: "*" * int(rng.integers(8, 16))])(), ""),
        "expression": lambda: (key(), pick([lambda: word() + "." + word() + "." + word(), lambda: "get_" + word() + "()", lambda: word() + "[" + word() + "]", lambda: word() + "." + word() + "(" + word() + ")", lambda: "os." + word() + "(" + word().upper() + ")"])(), ""),
        "words after a key": lambda: (named("key", "sort_key", "primary_key", "foreign_key", "keys", "Key", "public_key_id", "token_type") + equals(), pick([lambda: word() + "_" + word() + pick(["", pick(digits)]), lambda: word() + word(), lambda: "/" + word() + "/" + word(), lambda: "https://" + word() + ".com/" + word(), lambda: word() + "-" + word() + "-" + of(digits, 2)])(), ""),
        "password of an example": lambda: (scheme() + pick(["user", "username", word()]) + ":", pick(["password", "<" + word() + ">", "${" + word().upper() + "}", "pass", "your_" + word(), "xxxx", "****", "$" + word().upper(), "{" + word() + "}"]), host()),
        "date": lambda: (plain(), of(digits, 4) + "-" + of(digits, 2) + "-" + of(digits, 2) + "T" + of(digits, 2) + ":" + of(digits, 2) + "Z", ""),
        "value": lambda: (plain(), pick([lambda: word() + "-" + of(digits, 4) + "-" + word(), lambda: word() + "." + word() + of(digits, 2) + "." + word(), lambda: word() + word() + of(digits, 2), lambda: word() + "(" + word() + pick(digits) + ")", lambda: "/" + word() + "/" + word() + of(digits, 2) + "?" + word()])(), ""),
        "integrity": lambda: (pick(["integrity=", 'integrity="', "sri: "]), "sha256-" + mixed(42, 42, "+/") + "=", ""),
        "address": lambda: (plain(), "https://" + word() + ".com/" + word() + "/" + of(digits, 5), ""),
        "style": lambda: (pick(["class=", 'class="', "id="]), pick([word() + "-", "css-", word() + "__"]) + of(hexes, 6, 10) + pick(["", "-" + word()]), ""),
        "spoken prose": lambda: (pick(["the ", "your ", "this "]) + pick(["password", "secret", "token", "passphrase"]) + " is ", pick([lambda: word() + "-" + word() + of(digits, 1), lambda: word() + "_" + word(), lambda: of(digits, 1, 2) + "-" + word(), lambda: word() + "s!", lambda: of(digits, 6, 8)])(), " " + word()),
    }
    return {k: (1, v) for k, v in secret.items()} | {k: (0, v) for k, v in other.items()}


def labelled_findings(
    vocabulary: str, n: int = 3000, seed: int = 7, only: tuple[str, ...] = (), without: tuple[str, ...] = ()
) -> list[tuple[str, str, str, str, int, str]]:
    """(kind, value, before, after, label, family): findings with known labels, as the candidate patterns find them in made
    texts of known secrets and of what is mistaken for them. ``n`` bounds what the forest is grown from."""
    rng = np.random.default_rng(seed)
    words = words_of(vocabulary)
    families = _families(rng, words)
    names = {label: [k for k, (x, _) in families.items() if x == label and (not only or k in only) and k not in without] for label in (0, 1)}
    prose = lambda: " ".join(words[int(k)] for k in rng.integers(0, len(words), 6))
    out = []
    for k in range(n):
        own = names[k % 2] or names[1 - k % 2]
        family = own[int(rng.integers(0, len(own)))]
        label, make = families[family]
        before, value, after = make()
        start = len(lead := prose() + " " + before)
        text = lead + value + ('"' if lead[-1:] == '"' else "'" if lead[-1:] == "'" else "") + after + " " + prose()
        for a, b, kind, found, left, right in candidates(text):
            if a < start + len(value) and b > start:
                out.append((kind, found, left, right, label, family))
    return out


class Forest:
    """Decision trees on bootstrap samples, each split looking at a random subset of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 4, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[rows], y[rows], depth, least, rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> tuple:
        share = float(y.mean())
        if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
            return (share,)
        best = (1e9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            left = np.cumsum(t)[:-1]
            n_left = np.arange(1, len(t))
            p, q = left / n_left, (t.sum() - left) / (len(t) - n_left)
            gini = n_left * p * (1 - p) + (len(t) - n_left) * q * (1 - q)
            gini[(v[1:] == v[:-1]) | (n_left < least) | (len(t) - n_left < least)] = 1e9
            k = int(np.argmin(gini))
            if gini[k] < best[0]:
                best = (float(gini[k]), int(f), float((v[k] + v[k + 1]) / 2))
        if best[1] < 0:
            return (share,)
        go = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[go], y[go], depth - 1, least, rng), self._grow(x[~go], y[~go], depth - 1, least, rng)

    def probability(self, row: list[float]) -> float:
        total = 0.0
        for node in self.trees:
            while len(node) > 1:
                node = node[2] if row[node[0]] <= node[1] else node[3]
            total += node[0]
        return total / len(self.trees)


def train(findings: list[tuple[str, str, str, str, int, str]], vocabulary: str) -> Forest:
    x = np.array([features(*f[:4], vocabulary) for f in findings], float)
    return Forest(x, np.array([f[4] for f in findings], float))


@lru_cache(maxsize=4)
def grown(vocabulary: str, n_labelled: int = 3000, seed: int = 7) -> Forest:
    return train(labelled_findings(vocabulary, n_labelled, seed), vocabulary)


def candidates(text: str) -> Iterator[tuple[int, int, str, str, str, str]]:
    """(start, end, kind, value, before, after) of the candidates of one text, from left to right."""
    for m in SCAN.finditer(text):
        kind = m.lastgroup
        group = INNER.get(kind, kind)
        start, end = m.span(group)
        yield start, end, kind, m[group], text[max(0, start - 64) : start], text[end : end + 48]


def _scan(text: str, forest: Forest, threshold: float, vocabulary: str) -> list[tuple[int, int, str, str, float, bool]]:
    out = []
    for start, end, kind, value, before, after in candidates(text):
        p = forest.probability(features(kind, value, before, after, vocabulary))
        out.append((start, end, kind, value, p, p >= threshold))
    return out


def scan_secrets(docs: DataFrame, vocabulary: str, threshold: float = 0.5, n_labelled: int = 3000, seed: int = 7) -> DataFrame:
    """A row per candidate of every whole text: ``doc_id``, ``start`` and ``length`` in code points, ``kind``,
    ``value``, ``probability`` and ``is_secret``.

    Null and empty texts have no candidates; repeated rows each give theirs, an empty table none. The forest
    is grown on the driver from some ``n_labelled`` labelled findings, and travels with the tasks (some 100
    KB). ``vocabulary`` is the path of a rank file that all machines can read.
    """
    forest = grown(vocabulary, n_labelled, seed)

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            out = {k: [] for k in ("doc_id", "start", "length", "kind", "value", "probability", "is_secret")}
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                for start, end, kind, value, p, secret in _scan(text.as_py(), forest, threshold, vocabulary):
                    row = (doc_id.as_py(), start, end - start, kind, value, p, secret)
                    for k, v in zip(out, row):
                        out[k].append(v)
            yield out

    ddl = "doc_id bigint, start bigint, length bigint, kind string, value string, probability double, is_secret boolean"
    return map_columns(docs, [F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")], ddl, body)


def redact_secrets(docs: DataFrame, vocabulary: str, threshold: float = 0.5, mark: str = "[{kind}]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; no document goes. n_chars follows the text.

    Null texts stay null; a text without secrets stays as it is.
    """
    forest = grown(vocabulary)
    names = docs.columns
    at = names.index("text")

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            texts = []
            for x in batch.column(at):
                text, parts, last = x.as_py(), [], 0
                for start, end, kind, _, _, secret in _scan(text, forest, threshold, vocabulary) if text else ():
                    if secret:
                        parts += [text[last:start], mark.format(kind=kind)]
                        last = end
                texts.append("".join([*parts, text[last:]]) if parts else text)
            yield {c: texts if i == at else batch.column(i) for i, c in enumerate(names)}

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = map_columns(docs, [F.col(f"`{c}`") for c in names], ddl, body)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in names else out
