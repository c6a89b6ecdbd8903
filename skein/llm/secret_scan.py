"""Secret scans: rules, and two character Markov models compared by log-likelihood ratio.

The rules give spans of kind assign, access and hex. The models add spans of kind markov. They see what the rules' spans leave
of each run of `[A-Za-z0-9+/_=.-]`: the stretches of it that the model of random strings explains better than that of
ordinary identifiers, by `min_ratio` nats or more, are widened to the next separator on both sides, and are spans if they have at
least `shortest` characters, `min_distinct` of them different. So a key is found within a longer name or path, and in parts joined by dots.
Both are first-order models over the run's characters, trained from labelled samples (text, is_random): given ones, or those of `generated_samples` and
`learnt_samples` (values that rules find, words of the corpus, and identifiers made of such words). `min_ratio` is learnt as well:
the least at which no more than `false_rate` of ordinary samples that trained neither model are marked.

Edge cases: null and empty texts have no spans (empty strings, and the digest of one); long texts are scanned whole;
spans count code points, the end exclusive; repeated rows are scanned each. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
import string
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, text_of

#: The rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole: those of 32 and more
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = string.ascii_letters + string.digits + "+/_=-."
#: Every access or hex span lies in such a run.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{12,}")
_ROWS = (string.ascii_lowercase, string.digits, string.ascii_uppercase)
_PART = re.compile(r"[A-Za-z0-9]+")
_ORDINARY = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z_][A-Za-z0-9_-]{5,18}(?![A-Za-z0-9+/_=-])")
#: Words in regular case: a key of few characters that no rule finds mustn't teach what is ordinary.
_REGULAR = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)(?:[_-](?:[A-Z]?[a-z]+|[A-Z]+))*")
SAMPLE_ROWS, GENERATED, SMOOTH, BACK_OFF, NOISE = 20_000, 4_000, 0.5, 5.0, 0.05
WORDS, IDENTIFIERS = 5_000, 24_000
HELD_OUT, FALSE_RATE = 5, 1e-4
_CACHE = 50_000


@dataclass(frozen=True)
class MarkovPair:
    """ratio[a, b]: how much better the random model explains b after a; row len(ALPHABET) is the beginning."""

    ratio: np.ndarray
    min_ratio: float
    shortest: int = 12
    min_distinct: int = 8

    @staticmethod
    def train(samples: list[tuple[str, bool]], counts: np.ndarray | None = None, held_out: list[str] | None = None, false_rate: float = FALSE_RATE, **options) -> MarkovPair:
        """From labelled samples (text, is_random), and transition counts of further ones by label. The threshold comes from
        `held_out`, ordinary samples; without them from every fifth ordinary one of `samples` (by its crc32), which then trains nothing.
        It is never under -ln(false_rate), which bounds the share of what one model makes that the ratio takes for the other's."""
        if held_out is None:
            apart = [not is_random and zlib.crc32(text.encode()) % HELD_OUT == 0 for text, is_random in samples]
            held_out = [text for (text, _), x in zip(samples, apart, strict=True) if x]
            samples = [sample for sample, x in zip(samples, apart, strict=True) if not x]
        n = len(ALPHABET)
        total = np.zeros((2, n + 1, n)) + (0 if counts is None else counts)
        for text, is_random in samples:
            np.add.at(total[int(is_random)], _transitions(text), 1)
        alone = total.sum(axis=1, keepdims=True) + SMOOTH  # rare rows lean on how often characters occur at all
        total += BACK_OFF * alone / alone.sum(axis=2, keepdims=True)
        logs = np.log((1 - NOISE) * total / total.sum(axis=2, keepdims=True) + NOISE / n)  # one unseen pair decides nothing
        model = MarkovPair(logs[1] - logs[0], **({"min_ratio": 0.0} | options))
        if "min_ratio" in options:
            return model
        best = np.sort([model.best(x) for x in held_out if len(x) >= model.shortest])  # those that are judged
        allowed = int(false_rate * len(best))
        learnt = best[-1 - allowed] if len(best) else 0.0
        return replace(model, min_ratio=max(float(np.nextafter(learnt, np.inf)), -math.log(false_rate)))

    def score(self, run: str) -> float:
        return float(self.ratio[_transitions(run)].sum())

    def best(self, run: str) -> float:
        """The largest ratio of any stretch of the run."""
        sums = np.cumsum(self.ratio[_transitions(run)])
        return float((sums - np.minimum.accumulate(np.concatenate([[0.0], sums]))[:-1]).max(initial=0.0))

    def stretches(self, run: str) -> list[tuple[int, int]]:
        """Where the run looks random."""
        if len(run) < self.shortest or self.best(run) < self.min_ratio:
            return []
        out: list[list[int]] = []
        parts = [m.span() for m in _PART.finditer(run)]
        ends = [e for _, e in parts]
        for s, e in _maximal(self.ratio[_transitions(run)].tolist(), self.min_ratio):
            i, j = bisect.bisect_right(ends, s), bisect.bisect_left(ends, e)  # the parts that hold its first and last characters
            s, e = min(s, parts[i][0]) if i < len(parts) else s, max(e, parts[j][1]) if j < len(parts) and parts[j][0] < e else e
            if out and s <= out[-1][1]:
                out[-1][1] = max(e, out[-1][1])
            else:
                out.append([s, e])
        return [(s, e) for s, e in out if e - s >= self.shortest and len(set(run[s:e])) >= self.min_distinct]

    def is_random(self, run: str) -> bool:
        return bool(self.stretches(run))


def _maximal(values: list[float], least: float) -> list[tuple[int, int]]:
    """The stretches of largest sum that can't be lengthened or joined with gain, of a sum of at least `least`; one pass, a stack."""
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before it, sum up to its end
    total = 0.0
    for at, x in enumerate(values):
        before, total = total, total + x
        if x <= 0:
            continue
        start, low = at, before
        while stack:
            # A stretch that begins higher than this one is of no use to it; one that begins lower and ends lower is joined.
            k = len(stack) - 1
            while k >= 0 and stack[k][2] >= low:
                k -= 1
            if k < 0 or stack[k][3] >= total:
                break
            start, low = stack[k][0], stack[k][2]
            del stack[k:]
        stack.append((start, at + 1, low, total))
    return [(s, e) for s, e, low, high in stack if high - low >= least]


_CODE = np.full(128, -1)
_CODE[[ord(c) for c in ALPHABET]] = range(len(ALPHABET))


def _codes(run: str) -> np.ndarray:
    codes = _CODE[np.frombuffer(run.encode("ascii", "ignore"), np.uint8)]
    return codes[codes >= 0]


def _transitions(run: str) -> tuple[np.ndarray, np.ndarray]:
    codes = _codes(run)
    return np.concatenate([[len(ALPHABET)], codes])[:-1], codes


def rule_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    for s, e in runs:
        run = text[s:e]
        if "AKIA" in run:
            found += [(s + m.start(), 1, s + m.end()) for m in ACCESS.finditer(run) if len(m[0]) >= 16]
        if e - s >= 32:
            found += [(s + m.start(), 2, s + m.end()) for m in HEX.finditer(run)]
    return sorted(found)


def outside(runs: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What the spans (sorted) leave of the runs."""
    taken: list[list[int]] = []
    for s, _, e in spans:
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(e, taken[-1][1])
        else:
            taken.append([s, e])
    i = 0
    for s, e in runs:
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        j = i
        while j < len(taken) and taken[j][0] < e:
            if s < taken[j][0]:
                yield s, taken[j][0]
            s, j = taken[j][1], j + 1
        if s < e:
            yield s, e


def scan_text(text: str, model: MarkovPair, stretches: Callable[[str], list[tuple[int, int]]] | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The rules' spans, and all spans."""
    runs = [m.span() for m in RUN.finditer(text)]
    base = rule_spans(text, runs)
    find = stretches or model.stretches
    more = [(s + a, 3, s + b) for s, e in outside(runs, base) if e - s >= model.shortest for a, b in find(text[s:e])]
    return base, sorted(base + more)


def generated_samples(count: int = GENERATED) -> list[tuple[str, bool]]:
    """Random strings over the usual alphabets, made with a fixed seed."""
    own = random.Random(20)
    digits = string.ascii_letters + string.digits
    alphabets = [string.hexdigits[:16], digits, string.ascii_uppercase + "234567", digits + "+/", digits + "-_"]
    key = lambda i, least, most: "".join(own.choices(alphabets[i % len(alphabets)], k=own.randint(least, most)))
    return [(key(i, 20, 64) if i % 8 else ".".join(key(i // 8, 10, 40) for _ in range(3)), True) for i in range(count)]


def generated_identifiers(words: list[str], count: int = IDENTIFIERS, seed: int = 21) -> list[str]:
    """Identifiers of two to four of the words, in the usual forms, made with a fixed seed: prose alone has few of their
    separators, capitals and numbers."""
    own, out = random.Random(seed), []
    for i in range(count if words else 0):
        parts = own.choices(words, k=own.randint(2, 4))
        if own.random() < 0.3:
            parts[own.randrange(len(parts))] += str(own.randint(0, 99))
        form = i % 8
        if form < 3:
            out.append(("_-/"[form] if own.random() < 0.8 else "=").join(parts))
        elif form == 6:
            out.append(".".join(w.title() if own.random() < 0.2 else w for w in parts) + own.choice(["", ".", "..."]))
        elif form == 7:
            out.append("/".join([own.choice(["www.", "", "//", "api."]) + parts[0] + own.choice([".com", ".org", ".net", ".io"]), *parts[1:]]) + own.choice(["", ".html", f"={own.randint(0, 99)}"]))
        elif form == 3:
            out.append("".join(w.title() for w in parts))
        elif form == 4:
            out.append("_".join(parts).upper())
        else:
            number = str(own.randint(0, 9999)) if own.random() < 0.5 else f"{own.randint(1990, 2039)}-{own.randint(1, 12):02}-{own.randint(1, 28):02}"
            if own.random() < 0.2:
                number += f"T{own.randint(0, 23):02}.{own.randint(0, 59):02}.{own.randint(0, 59):02}" + own.choice(["", "Z", f".{own.randint(0, 999):03}"])
            if own.random() < 0.2:  # a placeholder, as abcdefgh or 45678
                row, first = own.choice(_ROWS), own.randint(0, 4)
                number = row[first : first + own.randint(5, 12)]
            parts.insert(own.randint(0, len(parts)), number)
            out.append(own.choice("_-/").join(parts))
    return out


def sample_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> np.ndarray:
    """Transition counts of `learnt_samples`."""
    return learnt_samples(docs, id_col, text_col, rows)[0]


def learnt_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, list[str]]:
    """Transition counts of labelled samples from about `rows` documents at most, chosen by hash: random are the values that
    the rules find, ordinary the words of 6 to 19 characters in regular case (in texts without a find; longer ones are what is judged), each
    different word once, and identifiers made of WORDS of them. A word in HELD_OUT (by hash) isn't counted: at most WORDS of these, and identifiers
    made of them, are returned beside the counts. The same rows give the same result, however they are dealt to tasks."""
    text = text_of(text_col)
    mine = F.pmod(F.xxhash64(F.col(id_col), text), F.lit(max(docs.count(), rows)))
    chosen = docs.where(mine < rows).select(text.alias("t"))
    n = len(ALPHABET)

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, int]] = []
            words: set[str] = set()
            for t in batch.column(0).to_pylist():
                spans = rule_spans(t, [m.span() for m in RUN.finditer(t)])
                found += [(ASSIGN.match(t, s)[2] if k == 0 else t[s:e], 1) for s, k, e in spans]
                if not spans:
                    words.update(filter(_REGULAR.fullmatch, _ORDINARY.findall(t)))
            found += [(w, 0) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([k for _, k in found], pa.int8())], names=["sample", "kind"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, n + 1, n), np.int64)
        for batch in batches:
            for w, kind, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                np.add.at(total[kind], _transitions(w), times if kind else 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "n"])

    distinct = materialize(chosen.mapInArrow(samples, "sample string, kind byte").groupBy("sample", "kind").agg(F.count(F.lit(1)).alias("times")), "secret-samples")
    out = np.zeros(2 * (n + 1) * n)
    apart = F.expr("kind = 0") & (F.pmod(F.xxhash64("sample"), F.lit(HELD_OUT)) == 0)
    for x in distinct.where(~apart).select("sample", "kind", "times").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[x["at"]] = x["n"]
    out = out.reshape(2, n + 1, n)
    order = [F.xxhash64("sample"), F.col("sample")]
    known, unseen = ([r["sample"] for r in distinct.where(which & F.expr("kind = 0")).orderBy(*order).limit(WORDS).collect()] for which in (~apart, apart))
    letters = re.compile("[A-Za-z]+")
    for x in generated_identifiers([w for w in known if letters.fullmatch(w)]):
        np.add.at(out[0], _transitions(x), 1)
    return out, unseen + generated_identifiers([w for w in unseen if letters.fullmatch(w)], seed=22)


def scan(docs: DataFrame, model: MarkovPair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, n_markov, base_sha256, spans."""
    df = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    names = [id_col, "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"]
    show = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, int]]] = {}

        def stretches(run: str) -> list[tuple[int, int]]:
            if len(run) > 64:
                return model.stretches(run)
            if run not in known:
                if len(known) >= _CACHE:
                    known.clear()
                known[run] = model.stretches(run)
            return known[run]

        for batch in batches:
            out = []
            for t in batch.column("_text").to_pylist():
                base, spans = scan_text(t, model, stretches)
                out.append((*(sum(k == i for _, k, _ in spans) for i in range(4)), hashlib.sha256(show(base).encode()).hexdigest(), show(spans)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.string()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), *arrays], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return df.mapInArrow(find, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def find_secrets(docs: DataFrame, samples: list[tuple[str, bool]] | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    if samples is None:
        counts, held_out = learnt_samples(docs, id_col, text_col)
        model = MarkovPair.train(generated_samples(), counts, held_out, **options)
    else:
        model = MarkovPair.train(samples, **options)
    return scan(docs, model, id_col, text_col)
