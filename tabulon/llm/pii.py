"""Personal data by anchor expansion.

One Aho-Corasick automaton walks a text and stops at at-signs, plus signs, digits, schemes and identifier cues. At each
anchor a deterministic parser looks around it only: it widens to the span's borders, then validates (octets, Luhn and
IBAN check digits, digit counts). An anchor inside a span that its kind has already taken is passed over, so the spans of
a kind are leftmost and do not overlap.

Base kinds, with the borders that their published patterns give: email, ip, card, phone. Added kinds: ``url`` (a scheme with
what follows up to white space, quotes or angle brackets) and ``account`` (an identifier cue such as "IBAN", "account no",
"passport" or "token", then a separator and an identifier with at least four digits; IBANs must pass their check digits).

Offsets count code points, the end is exclusive. Defined results: null and empty texts have no spans; texts are read whole;
repeated rows give repeated results; extra columns are kept by ``find`` (an existing ``spans`` column raises ValueError).
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tabulon.llm import common

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "mailto:")
CUES = ("iban", "account", "acct", "ssn", "social security", "passport", "licence no", "license no", "tax id", "customer no", "api key", "api_key", "token", "secret", "password")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)").match
_DIGITS = re.compile(r"[0-9]+").match
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_URL = re.compile(r"[^\s\"'<>]+").match
_ACCOUNT = re.compile(r"""(?:[ ]?(?:no|nr|number|id))?\.?[ ]?[:=#]?[ ]?["']?([A-Za-z0-9](?:[A-Za-z0-9]|[ -](?=[A-Za-z0-9]*[0-9]))*)""", re.IGNORECASE).match
_WORD = re.compile(r"\w").match


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        if place % 2:
            digit = 2 * digit - 9 * (digit > 4)
        total += digit
    return total % 10 == 0


def iban(text: str) -> bool:
    text = re.sub(r"[ -]", "", text).upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


class Finder:
    def __init__(self) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for anchor in ("@", "+", *"0123456789"):
            self.automaton.add_word(anchor, (anchor if anchor in "@+" else "digit", 1))
        for scheme in SCHEMES:
            self.automaton.add_word(scheme, ("scheme", len(scheme)))
        for cue in CUES:
            for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
                self.automaton.add_word(form, (cue, len(form)))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[int, str, int]]:
        """(start, kind, end) by start, then kind in the order of KINDS."""
        if not text:
            return []
        found: list[tuple[int, int, int]] = []
        taken = dict.fromkeys(KINDS, 0)  # where the search for the next span of a kind begins
        for last, (anchor, size) in self.automaton.iter(text):
            if anchor == "digit":
                if last >= taken["card"] and (m := _CARD(text, last)):
                    taken["card"] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append((last, 2, m.end()))
                if last >= taken["ip"]:
                    if m := _IP(text, last):
                        taken["ip"] = m.end()
                        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (g.lstrip("0") for g in m.groups())):
                            found.append((last, 1, m.end()))
                    else:  # no later digit of this run can begin one
                        taken["ip"] = _DIGITS(text, last).end()
            elif anchor == "@":
                if last >= taken["email"] and (m := _DOMAIN(text, last + 1)):
                    start = last
                    while start > taken["email"] and text[start - 1] in _LOCAL:
                        start -= 1
                    if start < last:
                        taken["email"] = m.end()
                        found.append((start, 0, m.end()))
            elif anchor == "+":
                if last >= taken["phone"] and (m := _PHONE(text, last)):
                    taken["phone"] = m.end()
                    if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                        found.append((last, 3, m.end()))
            elif anchor == "scheme":
                start = last + 1 - size
                if start >= taken["url"] and not (start and _WORD(text, start - 1)) and (m := _URL(text, last + 1)):
                    end = last + 1 + len(m[0].rstrip(".,;:!?)"))
                    if end > last + 1:
                        taken["url"] = end
                        found.append((start, 4, end))
            else:
                start = last + 1 - size
                if start >= taken["account"] and not (start and _WORD(text, start - 1)) and not _WORD(text, last + 1) and (m := _ACCOUNT(text, last + 1)):
                    value = m[1]
                    if sum(c in "0123456789" for c in value) >= 4 and len(value) >= 6 and (anchor != "iban" or iban(value)):
                        taken["account"] = m.end(1)
                        found.append((m.start(1), 5, m.end(1)))
        found.sort()
        return [(start, KINDS[kind], end) for start, kind, end in found]


@functools.lru_cache(maxsize=1)
def finder() -> Finder:
    return Finder()


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def find(df: DataFrame, column: str = "text", output: str = "spans") -> DataFrame:
    """``df`` with the spans of ``column`` as array<struct<kind, start, end, value>>; one pass, no shuffle."""
    if output.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the input has a column {output} already; name another output")
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("value", T.StringType())]))
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        search = finder()
        rows = []
        for value in batch.column(batch.schema.names.index(column)):
            text = value.as_py() or ""
            rows.append([{"kind": k, "start": a, "end": z, "value": text[a:z]} for a, k, z in search(text)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, arrow)], names=[*batch.schema.names, output])

    return common.map_batches(df, run, T.StructType([*df.schema.fields, T.StructField(output, kind)]))


def redact(text: str | None, mask: str = "[{}]") -> str:
    """A text with every span replaced by its kind; of overlapping spans the first one, to the furthest end, counts."""
    text, out, at = text or "", [], 0
    for start, kind, end in finder()(text):
        if start >= at:
            out += [text[at:start], mask.format(kind.upper())]
        at = max(at, end)
    return "".join(out) + text[at:]


def digest_spans(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_url, n_account, n_spans) of every row, from the spans that
    the finder gives; n_spans counts all kinds."""
    added = KINDS[len(BASE) :]
    names = [key, *(f"n_{k}" for k in BASE), "base_sha256", "spans", *(f"n_{k}" for k in added), "n_spans"]
    kinds = [*[T.LongType()] * len(BASE), T.StringType(), T.StringType(), *[T.LongType()] * (len(added) + 1)]
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, k) for n, k in zip(names[1:], kinds, strict=True))])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        search = finder()
        counts: dict[str, list[int]] = {k: [] for k in KINDS}
        digests, spans, totals = [], [], []
        for value in batch.column(1):
            found = search(value.as_py() or "")
            base = [x for x in found if x[1] in BASE]
            for kind, own in counts.items():
                own.append(sum(x[1] == kind for x in found))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            spans.append(joined(found))
            totals.append(len(found))
        numbers = [pa.array(counts[k], pa.int64()) for k in KINDS]
        columns = [*numbers[: len(BASE)], pa.array(digests, pa.string()), pa.array(spans, pa.string()), *numbers[len(BASE) :], pa.array(totals, pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return common.map_batches(df.select(key, column), run, schema)
