"""Secret scans with a linear-chain conditional random field.

Every token is tagged B (a secret begins), I (inside one) or O. A tag's potential is
the sum of weights for the token's shape (classes of characters, length, variety,
known prefixes), its own word and its neighbours' where those are words seen in
training, and features of the file (how much of it looks like code or data); a
matrix scores neighbouring tags. Weights are fitted here by maximum likelihood
(forward-backward, Adam) on synthetic sentences made from a seed, so the model is a
constant of the parameters. No table is used for training.

Decoding is exact Viterbi over the whole document. A token whose O beats B and I by
more than the tag matrix could ever return is O in every best path, so the dynamic
programme only runs between such tokens.

Defined results
---------------
* NULL or empty text: no secrets. Very long documents are decoded whole.
* An I that doesn't follow B or I begins a secret; one without any letter or digit is none. Ties prefer O, then B.
* Repeated rows give their secrets each. NULL doc_id is carried. Empty table: no rows.
* Redaction keeps all columns and rows; only ``text`` and ``n_chars`` of documents with
  secrets change (n_chars only if the table has it).
"""

from __future__ import annotations

import math
import pickle
import random
import re
import string
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm.common import column, materialize, parts_of, table

TOKEN = re.compile(r"\w+(?:[-+/.~]\w+)*|[^\w\s]")
B, I, O = 0, 1, 2  # noqa: E741
SEED, SENTENCES, STEPS, MASK = 7, 6000, 120, "[SECRET]"
SCHEMA = "doc_id bigint, secret_no int, start_char int, end_char int, secret string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("secret_no", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("secret", pa.string())])
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat", "sk-", "sk_live", "pk_live", "xoxb", "xoxp", "eyJ", "AIza", "npm_", "SG.", "hf_", "ya29")


# ---- synthetic training sentences -------------------------------------------------

_KEYS = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_token", "auth_token", "client_secret", "secret_key", "private_key", "credentials", "aws_secret_access_key", "db_password", "PASSWORD", "TOKEN", "API_KEY", "SECRET", "Password", "Token"]
_PLAIN = ["commit", "sha1", "md5", "checksum", "uuid", "id", "order", "isbn", "version", "file", "page", "ref", "hash", "digest", "revision", "serial", "number", "date", "size", "name", "value", "count"]
_ALNUM, _HEX, _BASE = string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_letters + string.digits + "+/"


def _random(r: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(r.choice(letters) for _ in range(r.randint(low, high)))


def _word(r: random.Random) -> str:
    parts = ["th", "er", "on", "an", "in", "le", "ment", "eau", "ción", "ado", "que", "sch", "ung", "ver", "ñ", "é", "ü", "st", "ing", "ed", "ka", "lo", "mi", "re", "to", "a", "o"]
    w = "".join(r.choice(parts) for _ in range(r.randint(1, 4)))
    k = r.random()
    return w.capitalize() if k < 0.12 else w.upper() if k < 0.16 else w


def _secret(r: random.Random) -> str:
    k = r.randrange(11)
    if k == 0:
        return r.choice(["AKIA", "ASIA"]) + _random(r, string.ascii_uppercase + "234567", 16, 16)
    if k == 1:
        return _random(r, _HEX, 16, 64)
    if k == 2:
        return r.choice(["ghp_", "gho_", "ghs_", "hf_", "npm_"]) + _random(r, _ALNUM, 30, 40)
    if k == 3:
        return r.choice(["sk-", "sk_live_", "pk_live_", "glpat-", "xoxb-"]) + _random(r, _ALNUM, 20, 48)
    if k == 4:
        return ".".join(("eyJ" + _random(r, _ALNUM, 15, 30), "eyJ" + _random(r, _ALNUM, 20, 60), _random(r, _ALNUM + "-_", 20, 43)))
    if k == 5:
        return _random(r, _BASE, 24, 60) + r.choice(["", "=", "=="])
    if k == 6:
        return "AIza" + _random(r, _ALNUM, 35, 35)
    if k == 7:
        return _random(r, _ALNUM, 20, 44)
    if k == 8:
        return _random(r, string.ascii_uppercase + string.digits, 20, 32)
    if k == 9:
        return _random(r, _HEX.upper(), 32, 40)
    return _random(r, _HEX, 12, 24)


def _weak(r: random.Random) -> str:
    """What is only a secret because of the words before it."""
    return r.choice([_random(r, _ALNUM, 8, 14), _random(r, _HEX, 8, 20), _random(r, string.ascii_lowercase, 4, 8) + _random(r, string.digits, 1, 4), _random(r, string.digits, 6, 12), _random(r, string.ascii_letters, 8, 12)])


def _harmless(r: random.Random) -> str:
    k = r.randrange(14)
    if k == 0:
        return f"{_random(r, string.ascii_lowercase, 3, 8)}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com"
    if k == 1:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if k == 2:
        return r.choice([f"+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}", f"+{r.randint(20, 99)} {r.randint(10, 99)} {r.randint(1000000, 9999999)}"])
    if k == 3:
        return str(r.randint(4 * 10**15, 5 * 10**15))
    if k == 4:
        return f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}:00:00"
    if k == 5:
        return f"https://www.{_word(r).lower()}.example.org/{_word(r).lower()}/{r.randint(1, 99999)}?q={_word(r).lower()}"
    if k == 6:
        return r.choice(["commit ", "sha1 ", "md5: ", "checksum = ", "revision ", "digest "]) + _random(r, _HEX, 32, 40)
    if k == 7:
        return r.choice(["uuid ", "id ", "ref "]) + "-".join(_random(r, _HEX, n, n) for n in (8, 4, 4, 4, 12))
    if k == 8:
        return r.choice(_PLAIN) + r.choice(["=", ": ", " = "]) + r.choice([_word(r), str(r.randint(0, 10**6)), f'"{_word(r)}"'])
    if k == 9:
        return r.choice(["GPL-3.0", "CC BY-NC 4.0", "ISO-8859-1", "UTF-8", "HTTP/1.1", "MP3", "COVID19", "x86_64", "v1.2.3"])
    if k == 10:
        return f"({_word(r)}) {_word(r)}!! {_word(r)}*** {_word(r)}%%% {_word(r)}$$$ {_word(r)}###"
    if k == 11:
        return r.choice(["the password is required", "your token expired", "a secret of the", "password and token", "Password:", "keep the secret, then", "token = None", 'password = ""', "token ring"])
    if k == 12:
        return " | ".join(_word(r) for _ in range(4))
    return str(r.randint(0, 10**8))


def sentence(r: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A text and the character spans of the secrets in it."""
    out, spans = "", []
    code = r.random() < 0.25
    for _ in range(r.randint(1, 3)):
        out += " ".join((r.choice(["def", "return", "{", "}", "if", "var", ";", "("]) if code and r.random() < 0.3 else _word(r)) + r.choice(["", "", "", "", ",", "."]) for _ in range(r.randint(2, 9))) + r.choice([" ", "\n"])
        k = r.random()
        if k < 0.45:
            out += _harmless(r) + r.choice([" ", ". ", "\n", ", "])
            continue
        if k < 0.6:
            lead, tail, body = "", "", _secret(r)
            while re.fullmatch(r"[0-9a-f]*|[0-9A-F]*|[A-Za-z]*", body) and not body.startswith(_PREFIXES):
                body = _secret(r)
        else:
            quote = r.choice(["", "", '"', "'"])
            lead = r.choice(_KEYS) + r.choice(["=", ": ", " = ", ":", " := ", " is "]) + quote
            if r.random() < 0.15:
                lead = r.choice(["Authorization: Bearer ", "Bearer ", "export TOKEN=", "postgres://admin:", "--password "])
                quote = "@db.example.com" if lead.startswith("postgres") else ""
            tail, body = quote, _secret(r) if r.random() < 0.6 else _weak(r)
        out += lead
        spans.append((len(out), len(out) + len(body)))
        out += body + tail + r.choice([" ", ". ", "\n", ", ", ";"])
    out += " ".join(_word(r) for _ in range(r.randint(1, 6)))
    return out, spans


# ---- features -----------------------------------------------------------------------


def _shape(token: str) -> list[str]:
    if not any(c.isalnum() for c in token):
        return ["p:" + token]
    up, low = sum(c.isupper() for c in token), sum(c.islower() for c in token)
    dig, n = sum(c.isdigit() for c in token), len(token)
    size = "1" if n < 4 else "4" if n < 8 else "8" if n < 12 else "12" if n < 16 else "16" if n < 20 else "20" if n < 28 else "28" if n < 44 else "44"
    kind = ("A" if up else "") + ("a" if low else "") + ("0" if dig else "") + ("." if up + low + dig < n else "")
    turns = sum((a.isdigit() != b.isdigit()) or (a.isupper() != b.isupper()) for a, b in zip(token, token[1:], strict=False))
    out = [f"k:{kind}:{size}", f"k:{kind}", f"n:{size}", f"t:{min(turns, 12) // 2}:{size}"]
    if all(c in _HEX for c in token):
        out.append(f"hex:{size}:{min(dig, 3)}")
    if kind == "A0" and n == 20:
        out.append("key20")
    if n >= 12:
        out.append(f"u:{min(len(set(token)) * 8 // n, 8)}:{size}")
    out += ["x:" + p for p in _PREFIXES if token.startswith(p)]
    return out


def _wordish(token: str) -> str | None:
    """How neighbours see a token: words in lower case, punctuation, or a class."""
    if len(token) == 1 and not token.isalnum():
        return token
    if re.fullmatch(r"[A-Za-z][A-Za-z_-]{1,21}", token):
        return token.lower()
    return None


def file_class(tokens: int, marks: int, digits: int) -> int:
    """0 to 8: how much of a file is punctuation of code, and how much has digits."""
    def level(x: int) -> int:
        return 0 if x * 50 < tokens else 1 if x * 8 < tokens else 2

    return level(marks) * 3 + level(digits)


_LOWER, _TITLE, _CAPITALS = (re.compile(x).fullmatch for x in ("[a-zß-öø-ÿ]+", "[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+", "[A-ZÀ-ÖØ-Þ]+"))


def _plain_shape(token: str) -> tuple | None:
    """Equal for plain words whose shape features are equal; None for other tokens."""
    kind = 0 if _LOWER(token) else 1 if _TITLE(token) else 2 if _CAPITALS(token) else None
    if kind is None or token.startswith(_PREFIXES):
        return None
    n = len(token)
    size = bisect_right(_SIZES, n)
    return (kind, size, min(n, 2), not token.strip(_HEX), len(set(token)) * 8 // n if n >= 12 else -1, n == 20)


_SIZES = (4, 8, 12, 16, 20, 28, 44)
_MARKS = set("{}[]()<>=;:|&$#%@\"'_\\/*")


class Crf:
    """Weights by feature name, in the roles self, previous, next but one, and next."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, trans: np.ndarray, start: np.ndarray, files: np.ndarray) -> None:
        self.names, self.weights, self.trans, self.start, self.files = names, weights, trans, start, files
        t = trans
        worst = max(float((t[a, y] + t[y, b]) - (t[a, O] + t[O, b])) for a in range(3) for b in range(3) for y in (B, I))
        ends = max(float(start[y] - start[O] + t[y, b] - t[O, b]) for b in range(3) for y in (B, I))
        single = max(float(t[a, y] - t[a, O]) for a in range(3) for y in (B, I))
        alone = max(float(start[y] - start[O]) for y in (B, I))
        self.words = {f[3:] for f in names if f[1:3] == "w:"}
        self.margin = max(worst, ends, single, alone, 0.0) + 1e-6

    def rows(self, token: str) -> np.ndarray:
        """(4, 3): what the token adds to its own tags and to those of its neighbours."""
        out = np.zeros((4, 3), np.float64)
        word = _wordish(token)
        own = _shape(token) + (["w:" + word] if word else [])
        for f in own:
            i = self.names.get("0" + f)
            if i is not None:
                out[0] += self.weights[i]
        for role in (1, 2, 3):
            for f in (["w:" + word] if word else []) + own[:1]:
                i = self.names.get(str(role) + f)
                if i is not None:
                    out[role] += self.weights[i]
        return out


def emissions(rows: np.ndarray, file_row: np.ndarray) -> np.ndarray:
    """(n, 3) from (n, 4, 3): roles are own, one before, two before, one after."""
    e = rows[:, 0] + file_row
    e[1:] += rows[:-1, 1]
    e[2:] += rows[:-2, 2]
    e[:-1] += rows[1:, 3]
    return e


def viterbi(e: np.ndarray, trans: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[int]:
    """The best tags; ``first`` and ``last`` are added at the ends."""
    order = (O, B, I)  # ties prefer O, then B
    t = trans.tolist()
    score, back = (e[0] + first).tolist(), []
    for row in e[1:].tolist():
        step, new = [0, 0, 0], [0.0, 0.0, 0.0]
        for y in range(3):
            best, at = -math.inf, O
            for x in order:
                v = score[x] + t[x][y]
                if v > best:
                    best, at = v, x
            step[y], new[y] = at, best + row[y]
        back.append(step)
        score = new
    final = [score[y] + float(last[y]) for y in range(3)]
    tag = max(order, key=lambda y: final[y])
    out = [tag]
    for step in reversed(back):
        tag = step[tag]
        out.append(tag)
    return out[::-1]


def _prepared(seed: int, count: int) -> tuple[list[list[str]], list[list[int]], list[int]]:
    r = random.Random(seed)
    tokens, tags, files = [], [], []
    for _ in range(count):
        text, spans = sentence(r)
        found = list(TOKEN.finditer(text))
        tag, open_span = [], -1
        for m in found:
            inside = next((k for k, (a, b) in enumerate(spans) if m.start() >= a and m.end() <= b), -1)
            tag.append(O if inside < 0 else I if inside == open_span else B)
            open_span = inside
        tokens.append([m.group() for m in found])
        tags.append(tag)
        words = tokens[-1]
        files.append(file_class(len(words), sum(w in _MARKS for w in words), sum(any(c.isdigit() for c in w) for w in words)))
    return tokens, tags, files


@lru_cache(maxsize=2)
def train(seed: int = SEED, sentences: int = SENTENCES, steps: int = STEPS) -> Crf:
    """Fit the field to the synthetic sentences; the same weights every time."""
    tokens, tags, files = _prepared(seed, sentences)
    seen: dict[str, int] = {}
    names: dict[str, int] = {}
    kept = []
    for words in tokens:
        feats: list[list[str]] = [[] for _ in words]
        for i, token in enumerate(words):
            word = _wordish(token)
            own = _shape(token) + (["w:" + word] if word else [])
            near = (["w:" + word] if word else []) + own[:1]
            feats[i] += ["0" + f for f in own]
            for role, j in ((1, i + 1), (2, i + 2), (3, i - 1)):
                if 0 <= j < len(words):
                    feats[j] += [f"{role}{f}" for f in near]
        for fs in feats:
            for f in fs:
                seen[f] = seen.get(f, 0) + 1
        kept.append(feats)
    for f, c in seen.items():
        if c >= 5:
            names[f] = len(names)
    longest, wide = max(map(len, tokens)), max(len(fs) for feats in kept for fs in feats)
    n, pad = len(tokens), len(names)
    index = np.full((n, longest, wide), pad, np.int32)
    gold = np.full((n, longest), O, np.int64)
    live = np.zeros((n, longest), bool)
    for s, feats in enumerate(kept):
        live[s, : len(feats)] = True
        gold[s, : len(feats)] = tags[s]
        for i, fs in enumerate(feats):
            ids = [names[f] for f in fs if f in names]
            index[s, i, : len(ids)] = ids
    files_at = np.array(files)
    sizes = live.sum(1)
    w, trans, start, filew = np.zeros((pad + 1, 3)), np.zeros((3, 3)), np.zeros(3), np.zeros((9, 3))
    params = [w, trans, start, filew]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = np.random.default_rng(seed)
    size = min(1000, n)
    for step in range(1, steps + 1):
        some = order.choice(n, size, replace=False)
        top = sizes[some].max()
        idx, ok, y = index[some, :top], live[some, :top], gold[some, :top]
        e = w[idx].sum(2) + filew[files_at[some]][:, None]
        alpha = np.zeros((size, top, 3))
        alpha[:, 0] = e[:, 0] + start
        for t in range(1, top):
            v = alpha[:, t - 1, :, None] + trans
            m = v.max(1)
            nxt = m + np.log(np.exp(v - m[:, None]).sum(1)) + e[:, t]
            alpha[:, t] = np.where(ok[:, t, None], nxt, alpha[:, t - 1])
        beta = np.zeros((size, top, 3))
        for t in range(top - 2, -1, -1):
            v = trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            m = v.max(2)
            prv = m + np.log(np.exp(v - m[..., None]).sum(2))
            beta[:, t] = np.where(ok[:, t + 1, None], prv, 0.0)
        z = alpha[:, -1]
        zm = z.max(1)
        logz = zm + np.log(np.exp(z - zm[:, None]).sum(1))
        p = np.exp(alpha + beta - logz[:, None, None]) * ok[..., None]
        target = np.eye(3)[y] * ok[..., None]
        diff = p - target
        gw = np.stack([np.bincount(idx.ravel(), np.repeat(diff[..., k].ravel(), wide), pad + 1) for k in range(3)], 1) / size
        both = ok[:, 1:]
        pair = np.exp(alpha[:, :-1, :, None] + trans + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - logz[:, None, None, None]) * both[..., None, None]
        gt = (pair.sum((0, 1)) - np.einsum("sti,stj->ij", target[:, :-1] * both[..., None], target[:, 1:] * both[..., None])) / size
        gf = np.zeros((9, 3))
        np.add.at(gf, files_at[some], diff.sum(1) / size)
        grads = [gw, gt, diff[:, 0].sum(0) / size, gf]
        rate = 0.25 * (1 - 0.9 * step / steps)
        for k, (q, g) in enumerate(zip(params, grads, strict=True)):
            g = g + 1e-4 * q
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            q -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
        w[pad] = 0
    return Crf(names, w.copy(), trans.copy(), start.copy(), filew.copy())


_FITTED: dict[tuple, Crf] = {}


def fitted(spark: SparkSession, seed: int = SEED, sentences: int = SENTENCES, steps: int = STEPS) -> Crf:
    """:func:`train` in one task, once an application; the weights (bounded by the number of
    sentences) are a written table."""
    key = (spark.sparkContext.applicationId, seed, sentences, steps)
    if key not in _FITTED:

        def fit(batches):
            for _ in batches:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(seed, sentences, steps))], pa.binary())], names=["model"])

        stored = materialize(spark.range(0, 1, 1, 1).mapInArrow(fit, "model binary"), "secret-field")
        _FITTED[key] = pickle.loads(stored.first().model)
    return _FITTED[key]


# ---- decoding -------------------------------------------------------------------------


class Tagger:
    """Tags token lists; what tokens add to the potentials is remembered (bounded)."""

    def __init__(self, model: Crf, limit: int = 200_000) -> None:
        self.model, self.limit = model, limit
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.shared: dict[bytes, int] = {}
        self.plain: dict[tuple, int] = {}
        self.table: list[np.ndarray] = []
        self.array = np.zeros((0, 4, 3))
        self.counts: list[tuple[bool, bool]] = []
        self.flags = np.zeros((0, 2), np.int64)

    def _learn(self, tokens: list[str]) -> None:
        if len(self.known) > self.limit:
            self._clear()
        for token in set(tokens):
            if token not in self.known:
                plain = _plain_shape(token) if token.lower() not in self.model.words else None
                if plain is not None:
                    at = self.plain.get(plain)
                    if at is not None:
                        self.known[token] = at
                        continue
                rows = self.model.rows(token)
                flags = (token in _MARKS, any(c.isdigit() for c in token))
                same = rows.tobytes() + bytes(flags)
                at = self.shared.get(same)
                if at is None:
                    at = self.shared[same] = len(self.table)
                    self.table.append(rows)
                    self.counts.append(flags)
                self.known[token] = at
                if plain is not None:
                    self.plain[plain] = at
        if len(self.table) != len(self.array):
            self.array = np.stack(self.table)
            self.flags = np.array(self.counts, np.int64)

    def potentials(self, tokens: list[str]) -> np.ndarray:
        try:
            at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        except KeyError:
            self._learn(tokens)
            at = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        marks, digits = self.flags[at].sum(0)
        return emissions(self.array[at], self.model.files[file_class(len(tokens), int(marks), int(digits))])

    def spans(self, tokens: list[str]) -> list[tuple[int, int]]:
        """Token spans of the secrets."""
        if not tokens:
            return []
        m = self.model
        e = self.potentials(tokens)
        unsure = np.flatnonzero(e[:, O] - np.maximum(e[:, B], e[:, I]) <= m.margin)
        out: list[tuple[int, int]] = []
        if not len(unsure):
            return out
        cuts = np.flatnonzero(np.diff(unsure) > 1) + 1
        for run in np.split(unsure, cuts):
            a, b = int(run[0]), int(run[-1]) + 1
            tags = viterbi(e[a:b], m.trans, m.start if a == 0 else m.trans[O], np.zeros(3) if b == len(tokens) else m.trans[:, O])
            begun = -1
            for i, tag in enumerate([*tags, O], a):
                if begun >= 0 and tag != I:
                    out.append((begun, i))
                    begun = -1
                if tag == B or (tag == I and begun < 0):
                    begun = i
        return out

    def secrets(self, text: str | None) -> list[tuple[int, int]]:
        """Character spans of the secrets of a text."""
        if not text:
            return []
        found = self.spans(TOKEN.findall(text))
        if not found:
            return []
        places = [m.span() for m in TOKEN.finditer(text)]
        return [(x, y) for x, y in ((places[a][0], places[b - 1][1]) for a, b in found) if any(c.isalnum() for c in text[x:y])]


def secret_spans(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """(doc_id, secret_no, start_char, end_char, secret) of all documents: a map, no shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(model or fitted(docs.sparkSession))
    rows = docs.select(column(docs, "doc_id", "bigint").alias("doc_id"), column(docs, "text", "string").alias("text")).where("text IS NOT NULL")

    def scan(batches):
        tagger = Tagger(sent.value)
        for part in parts_of(batches, "doc_id", "text"):
            out = [(doc_id, i, a, b, text[a:b]) for doc_id, text in part for i, (a, b) in enumerate(tagger.secrets(text))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return rows.mapInArrow(scan, SCHEMA)


def redact(text: str, spans: list[tuple[int, int]], mask: str = MASK) -> str:
    parts, at = [], 0
    for a, b in spans:
        parts += [text[at:a], mask]
        at = b
    return "".join([*parts, text[at:]])


def redact_secrets(docs: DataFrame, model: Crf | None = None, mask: str = MASK) -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mask``; columns unchanged."""
    names = docs.columns
    lower = [c.lower() for c in names]
    at = lower.index("text")
    kinds = [f.dataType.simpleString() for f in docs.schema.fields]
    schema = ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))
    sent = docs.sparkSession.sparkContext.broadcast(model or fitted(docs.sparkSession))

    def scan(batches):
        tagger = Tagger(sent.value)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            out = [t if not (s := tagger.secrets(t)) else redact(t, s, mask) for t in texts]
            arrays = list(batch.columns)
            arrays[at] = pa.array(out, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    done = docs.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(scan, schema)
    if "n_chars" in lower:
        n = lower.index("n_chars")
        masked = F.when(F.contains(F.col(f"c{at}"), F.lit(mask)), F.length(f"c{at}").cast(kinds[n])).otherwise(F.col(f"c{n}"))
        done = done.withColumn(f"c{n}", masked)
    return done.toDF(*names)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


QUERIES = {"op4_secrets": op4_secrets}
ORACLES: dict = {}
