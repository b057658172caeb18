"""Personal data and secrets by weak supervision.

Broad patterns propose spans of each kind; five labelers (format, shape, gazetteer, context,
surroundings) vote on each. How often each pattern of votes occurs is counted over all
documents, and expectation-maximisation estimates from these counts how reliable each labeler
is. The posteriors train a logistic regression on the votes and on features of the span and its
context (its length, the word before it, what stands around it), which decides about every
proposed span that the format rules alone don't find. Spans that the format rules find always
stay. Secrets, assigned to a name such as "token", are a kind of their own without format rules.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floppyscope.llm.common import in_batches, table, written

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds that format rules find.
BASE = 4

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A match can't start within a run of digits: if the run's first digit fails, so does every other.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")

#: Proposals beyond the format rules: (kind, pattern, a character that such a span holds).
_LABEL = r"[A-Za-z0-9-]{1,63}"
_AT = r"(?:\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?|\x20@\x20?|@\x20)"
_DOT = r"(?:\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20|\.)"
_IP_DOT = r"(?:\x20?[\[({](?:dot|DOT|\.)[\])}]\x20?|\x20(?:dot|DOT)\x20|\x20\.\x20?|\.\x20)"
_GAP = r"(?:[./_\t\u00A0\u2010-\u2015]|\x20[-./]\x20|\x20\x20|--)"
PROPOSED = (
    (0, re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})++|\x20(?:at|AT)\x20{_LABEL}(?:\x20(?:dot|DOT)\x20{_LABEL})++)"), re.compile(r"@|\bat\b|\bAT\b")),
    (1, re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{_IP_DOT}[0-9]{{1,3}}){{3}}(?![0-9])"), re.compile(r"[0-9]\x20?[.\[({]|[0-9]\x20(?:dot|DOT)")),
    (2, re.compile(rf"(?<![0-9])(?:[0-9]{{4}}({_GAP})[0-9]{{4}}\1[0-9]{{4}}\1[0-9]{{2,7}}|[0-9]{{4}}({_GAP})[0-9]{{6}}\2[0-9]{{4,5}})(?![0-9])"), _DIGIT),
    (3, re.compile(r"(?<![0-9+.])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20/])[0-9]{3}[-.\x20][0-9]{4}(?![0-9])"), _DIGIT),
    (3, re.compile(r"(?<![0-9+.])00[\x20.-]?[1-9][0-9]{0,2}(?:[\x20.()/-]{1,2}[0-9]{2,8}){2,5}(?![0-9])"), _DIGIT),
    (3, re.compile(r"(?<![0-9+.])0[1-9](?:[\x20.-][0-9]{2}){4}(?![0-9])"), _DIGIT),
    (3, re.compile(r"(?<![0-9+.])\(?0[1-9][0-9]{1,4}\)?[\x20/-]{1,3}[0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9])"), _DIGIT),
    (4, re.compile(r"(?i:\b(?:api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|auth[_-]?token|access[_-]?token|token|secret|password|passwd|pwd|bearer|key))\b[\x20\"']{0,2}(?::=|=>|[:=]|\x20)[\x20]?[\"'`]?([A-Za-z0-9+/_.~$!-]{8,512})"), re.compile(r"(?i:token|secret|passw|pwd|bearer|key)")),
)

#: Top-level domains and calling codes that the gazetteer labeler knows.
TOP_LEVEL = set("com org net edu gov mil int info biz io co de fr es it uk us ca eu nl be ch at pl se no dk fi pt jp cn in br au ru".split())
CALLING = ("1", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "64", "7", "81", "82", "86", "90", "91")
#: First digits of payment cards.
ISSUERS = re.compile("4|5[1-5]|2[2-7]|3[47]|6")
FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|reach)\b", re.I),
    "ip": re.compile(r"\b(?:ip|address|host|server|from|login|client)\b", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|debit|payment|pan)\b", re.I),
    "phone": re.compile(r"\b(?:phone|tel|call|mobile|cell|fax|telefon|tél|dial)\b", re.I),
    "secret": re.compile(r"\b(?:api|auth|access|secret|token|password|bearer|credentials?|private)", re.I),
}
AGAINST = re.compile(r"\b(?:version|release|isbn|issn|order|invoice|serial|part|section|chapter|build|example)\b", re.I)
BEFORE = 40
#: Hashes of the word before a span that the classifier tells apart, and so all its features.
WORDS_BEFORE = 16
FEATURES = 4 * WORDS_BEFORE * 3
#: How known kinds of secrets begin.
PREFIXES = ("sk-", "sk_", "pk_", "ghp_", "gho_", "AKIA", "ASIA", "xox", "eyJ", "AIza", "glpat-")
_HEX = re.compile(r"(?:[0-9a-f]{2}){8,}|(?:[0-9A-F]{2}){8,}")
_DIGITS = re.compile("[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the email format: from each @ the local part is read backwards."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(last, at + 1))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of the matches that pass the format rules, and of those that fail."""
    good: list[tuple[int, int, int]] = []
    bad: list[tuple[int, int, int]] = []
    if "@" in text:
        good += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                fits = all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))
                (good if fits else bad).append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = _NOT_DIGIT.sub("", m.group())
                if len(digits) >= 14:
                    (good if len(digits) <= 19 and luhn(digits) else bad).append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                n = len(_NOT_DIGIT.sub("", m.group()))
                (good if 10 <= n <= 15 else bad).append((m.start(), 3, m.end()))
    good.sort()
    return good, bad


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Spans that only the broad patterns find, in order."""
    out = []
    for kind, pattern, hint in PROPOSED:
        if hint.search(text):
            g = 1 if kind == 4 else 0
            out += [(m.start(g), kind, m.end(g)) for m in pattern.finditer(text)]
    return sorted(out)


def _free(spans: list[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The ``spans`` (in order) that overlap none of ``taken`` (in order) and no earlier span."""
    starts = [a for a, _, _ in taken]
    ends = list(accumulate((b for _, _, b in taken), max))  # the furthest end of each and those before
    out, reach = [], 0
    for span in spans:
        k = bisect_left(starts, span[2])
        if reach <= span[0] and (not k or ends[k - 1] <= span[0]):
            out.append(span)
            reach = span[2]
    return out


def votes(text: str, start: int, kind: int, end: int, passed: int) -> tuple[int, ...]:
    """The votes of the five labelers on a span: 1 for, -1 against, 0 none. ``passed``: the
    verdict of the format rules, 0 where they don't match the span."""
    span = text[start:end]
    name = KINDS[kind]
    before = text[max(0, start - BEFORE) : start]
    if kind == 0:
        last = re.split(r"[^A-Za-z0-9-]+", span)[-1].lower()
        known = 1 if last in TOP_LEVEL else -1
        # Plain words ("at", "dot") have the shape of an address with a domain that exists only.
        marked = any(c in "@[({" for c in span)
        shape = 1 if last.isalpha() and len(last) > 1 and (marked or known > 0) else -1
    elif kind == 1:
        parts = _DIGITS.findall(span)
        shape = 1 if all(len(p) < 4 and int(p) < 256 for p in parts) else -1
        known = -1 if parts[0].lstrip("0") in ("", "127", "255") else 1
    elif kind == 4:
        shape = 1 if len(span) >= 16 and any(c.isdigit() for c in span) and any(c.isalpha() for c in span) else -1
        known = 1 if _HEX.fullmatch(span) or span.startswith(PREFIXES) else 0 if shape > 0 else -1
    else:
        digits = _NOT_DIGIT.sub("", span)
        if kind == 2:
            shape = 1 if re.fullmatch(r"[0-9]+|[0-9]{4}([^0-9]+)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([^0-9]+)[0-9]{6}\2[0-9]{4,5}", span) and luhn(digits) else -1
            known = 1 if ISSUERS.match(digits) else -1
        else:
            shape = 1 if 7 <= len(digits) <= 15 and span.count("(") == span.count(")") else -1
            known = 1 if span[0] == "+" and digits.startswith(CALLING) or digits.startswith("00") and digits[2:].startswith(CALLING) else 0
    context = -1 if AGAINST.search(before) else 1 if FOR[name].search(before) else 0
    around = text[start - 1 : start] + text[end : end + 1]
    return passed, shape, known, context, -1 if any(c.isalnum() or c in "=/_" for c in around) else 1


def features(text: str, start: int, end: int) -> int:
    """Features of a span and its context beside the votes, as a number under FEATURES: how
    long it is, a hash of the word before it, and what follows it."""
    n = end - start
    length = 0 if n < 12 else 1 if n < 18 else 2 if n < 30 else 3
    words = _LETTERS.findall(text[max(0, start - BEFORE) : start].lower())
    word = zlib.crc32(words[-1].encode()) % WORDS_BEFORE if words else 0
    after = text[end : end + 1]
    follows = 0 if not after or after.isspace() else 1 if after in ".,;:!?)]}\"'>" else 2
    return (length * WORDS_BEFORE + word) * 3 + follows


CANDIDATES = "row long, doc_id long, base string, counts array<long>, spans array<struct<start:long,kind:int,end:long,base:boolean,votes:string,more:int>>"
_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("more", pa.int32())])


def candidates(documents: DataFrame) -> DataFrame:
    """One row per document with its base spans and every proposed span with its votes."""

    def of(text: str) -> tuple[str, list[int], list[dict]]:
        good, bad = base_spans(text)
        counts = [0, 0, 0, 0]
        for _, kind, _ in good:
            counts[kind] += 1
        base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in good)
        spans = [(*s, True, 1) for s in good] + [(*s, False, -1) for s in bad]
        # What overlaps a base span isn't proposed: base spans stay as they are.
        spans += [(*s, False, 0) for s in _free(proposals(text), good)]
        found = []
        for a, k, b, is_base, passed in spans:
            found.append({"start": a, "kind": k, "end": b, "base": is_base, "votes": "".join("-0+"[v + 1] for v in votes(text, a, k, b, passed)), "more": features(text, a, b)})
        return base, counts, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [of(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(rows)), pa.int64()), batch.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(_SPAN))],
                ["row", "doc_id", "base", "counts", "spans"],
            )

    return in_batches(documents.select("doc_id", "text")).mapInArrow(run, CANDIDATES)


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 50) -> dict[str, float]:
    """For each pattern of votes the probability that its span is personal data, by
    expectation-maximisation over two classes with labelers that err independently. Whether a
    labeler votes at all says nothing about the class; how it votes is taken to be right more
    often than not, with pseudo-counts of a tenth of the spans: that holds the classes in place."""
    if not patterns:
        return {}
    total = sum(n for _, n in patterns)
    weight = 1 + total / 10
    q = {v: min(0.95, max(0.05, 0.5 + 0.15 * (v.count("+") - v.count("-")))) for v, _ in patterns}
    for _ in range(rounds):
        prior = (sum(q[v] * n for v, n in patterns) + 1) / (total + 2)
        odds = {}  # of each labeler and vote
        for k in range(5):
            rate = {}
            for c in (0, 1):
                hits = {mark: sum((q[v] if c else 1 - q[v]) * n for v, n in patterns if v[k] == mark) for mark in "-+"}
                for mark in "-+":
                    lean = 0.75 if (mark == "+") == bool(c) else 0.25
                    rate[c, mark] = (hits[mark] + lean * weight) / (hits["-"] + hits["+"] + weight)
            odds |= {(k, mark): math.log(rate[1, mark] / rate[0, mark]) for mark in "-+"}
        for v, _ in patterns:
            score = math.log(prior / (1 - prior)) + sum(odds.get((k, m), 0.0) for k, m in enumerate(v))
            q[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, score))))
    return q


def span_classifier(patterns: list[tuple[str, int, int]], rounds: int = 300) -> dict[tuple[str, int], float]:
    """The probability of each pattern (votes, features, how often) after a logistic regression
    on votes and features, trained on the posteriors of the votes."""
    if not patterns:
        return {}
    by_votes: dict[str, int] = {}
    for v, _, n in patterns:
        by_votes[v] = by_votes.get(v, 0) + n
    soft = reliabilities(sorted(by_votes.items()))
    x = np.zeros((len(patterns), 1 + 10 + 4 + WORDS_BEFORE + 3))
    x[:, 0] = 1
    for i, (v, more, _) in enumerate(patterns):
        for k, mark in enumerate(v):
            x[i, 1 + k] = mark == "+"
            x[i, 6 + k] = mark == "-"
        x[i, 11 + more // (3 * WORDS_BEFORE)] = 1
        x[i, 15 + more // 3 % WORDS_BEFORE] = 1
        x[i, 15 + WORDS_BEFORE + more % 3] = 1
    target = np.array([soft[v] for v, _, _ in patterns])
    weight = np.sqrt(np.array([n for _, _, n in patterns], np.float64))
    weight /= weight.sum()
    w, squares = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)

    def p() -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))

    for _ in range(rounds):
        g = x.T @ (weight * (p() - target)) + 1e-4 * w
        squares += g * g
        w -= 0.3 * g / np.sqrt(squares)
    return {(v, more): float(q) for (v, more, _), q in zip(patterns, p())}


def find(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``documents``: counts and digest of the base spans, all spans, and
    ``n_spans`` of them (secrets among them).

    A span that fails a format rule (a checksum, a range, a length) is never added. A null
    text counts as empty; repeated rows come out as often as they went in.
    """
    found = written(candidates(documents), "pii")
    # Votes of five labelers, features and kinds: 3**5 * FEATURES * 5 rows at most, however many documents.
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.more").agg(F.count("*").alias("n")).collect()
    good = []
    for kind in range(len(KINDS)):
        patterns = sorted((r["votes"], r["more"], r["n"]) for r in counted if r["kind"] == kind)
        good += [f"{kind}{v}{more}" for (v, more), p in span_classifier(patterns).items() if p >= threshold and v[0] == "0"]
    keep = F.filter("spans", lambda s: s["base"] | (F.concat(s["kind"].cast("string"), s["votes"], s["more"].cast("string")).isin(good) if good else F.lit(False)))
    name = F.array(*map(F.lit, KINDS))
    text = F.transform(F.array_sort(keep), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"], s["end"]))
    return found.select(
        "doc_id",
        *(F.col("counts")[k].alias(f"n_{KINDS[k]}") for k in range(BASE)),
        F.sha2("base", 256).alias("base_sha256"),
        F.array_join(text, ",").alias("spans"),
        F.size(text).cast("long").alias("n_spans"),
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
