"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, plus signs, digits, schemes, identifier cues) in one pass over
a text. Local parsers expand an anchor to the left and right by fixed character sets and validate what they get.
Each parser is deterministic: it consumes maximal runs and never retries, so it reports the leftmost,
non-overlapping spans of its kind.

Kinds: ``email``, ``ip``, ``card`` (16 to 19 digits, Luhn), ``phone`` (8 to 15 digits) are the base; the anchors add
``account`` (a number behind a cue such as IBAN, account or passport; an IBAN must pass its check digits) and ``login``
(the user part of ``scheme://user@host``). Spans are code points, end exclusive.

Defined results: a null or empty text has no spans; repeated rows each get their own result; an empty table gives an
empty table; a column that bears the output's name is replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, functions as F

from refrain.llm.common import ship, whole_text, worker_cache

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("account", "login")
#: Character sets of the parsers, and cues that announce an identifier.
DIGITS = frozenset(string.digits)
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
LABEL = frozenset(string.ascii_letters + string.digits + "-")
PHONE = frozenset(" ().-" + string.digits)
LETTERS_DIGITS = frozenset(string.ascii_letters + string.digits)
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
CUES = ("iban", "account", "acct", "passport", "ssn", "customer id", "tax id")
#: What may stand between a cue and its number: marks, and words that a mark follows.
MARKS, NUMBER_WORDS = frozenset(" :=#.-"), ("number", "num", "nr", "no")
#: No identifier has more letters and digits (an IBAN has up to 34); a longer run is none, and is not read further.
LONGEST_NUMBER = 34
SPANS = "array<struct<kind:string,start:int,end:int>>"


def run_end(text: str, at: int, stop: int, chars: frozenset) -> int:
    while at < stop and text[at] in chars:
        at += 1
    return at


def run_start(text: str, at: int, floor: int, chars: frozenset) -> int:
    while at > floor and text[at - 1] in chars:
        at -= 1
    return at


def email_at(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address round the at-sign, its left part beginning at ``floor`` or later."""
    n, start = len(text), run_start(text, at, floor, LOCAL)
    end = run_end(text, at + 1, n, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 0
    while end + 1 < n and text[end] == "." and text[end + 1] in LABEL:
        end, labels = run_end(text, end + 1, n, LABEL), labels + 1
    return (start, end) if labels else None


def ip_from(text: str, start: int) -> tuple[int, bool] | None:
    """Where four dotted numbers from ``start`` end, and whether each is at most 255."""
    n, at, fits = len(text), start, True
    for part in range(4):
        if part:
            if at >= n or text[at] != ".":
                return None
            at += 1
        end = run_end(text, at, n, DIGITS)
        if end == at:
            return None
        value = text[at:end].lstrip("0")
        fits &= len(value) <= 3 and int(value or "0") <= 255
        at = end
    return at, fits


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits_from(text: str, start: int) -> int:
    """End of the digits from ``start`` with at most one space or hyphen between two of them."""
    n, at = len(text), start + 1
    while at < n:
        if text[at] in DIGITS:
            at += 1
        elif text[at] in " -" and at + 1 < n and text[at + 1] in DIGITS:
            at += 2
        else:
            break
    return at


def phone_from(text: str, plus: int) -> tuple[int, int] | None:
    """End of the number behind a plus sign, and how many digits it has."""
    n = len(text)
    if plus + 1 >= n or text[plus + 1] not in DIGITS:
        return None
    end = run_end(text, plus + 2, n, PHONE)
    while end > plus + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= plus + 3:
        return None
    return end, sum(c in DIGITS for c in text[plus:end])


def number_word(text: str, at: int) -> int:
    """Length of a word for number at ``at`` that a mark follows, else 0."""
    ahead = text[at:at + 7].translate(LOWER)
    return next((len(w) for w in NUMBER_WORDS if ahead.startswith(w) and text[at + len(w):at + len(w) + 1] in MARKS), 0)


def norway(text: str, at: int) -> bool:
    """Whether the letters NO are an IBAN's country, with its check digits set apart."""
    return text.startswith("NO", at) and text[at + 2:at + 3] in (" ", "-") and text[at + 3:at + 4] in DIGITS


def account_after(text: str, cue: str, at: int) -> tuple[int, int] | None:
    """The identifier behind a cue that ends before ``at``: letters and digits in groups, at least 6 digits."""
    n = len(text)
    start = at
    while start < n and text[start] not in DIGITS:  # marks and words end at the next letter, so no stretch is read for two cues
        if text[start] in MARKS:
            start += 1
            continue
        word = number_word(text, start)
        if cue == "iban" and text[start].isupper() and (not word or norway(text, start)):
            break
        if not word:
            return None
        start += word
    end, size = start, 0
    follows = LETTERS_DIGITS if cue == "iban" else DIGITS  # what may come after a space or hyphen inside the number
    while end < n and (text[end] in LETTERS_DIGITS or (text[end] in " -" and end + 1 < n and text[end + 1] in follows)):
        if cue == "iban" and text[end].islower():
            break
        size += text[end] in LETTERS_DIGITS
        if size > LONGEST_NUMBER:
            return None
        end += 1
    end -= cue == "iban" and end > start and text[end - 1] in " -"
    value = "".join(c for c in text[start:end] if c in LETTERS_DIGITS)
    if cue == "iban":
        if not (15 <= len(value) and value[:2].isalpha() and value[2:4].isdigit()):
            return None
        turned = value[4:] + value[:4]
        return (start, end) if int("".join(str(int(c, 36)) for c in turned)) % 97 == 1 else None
    return (start, end) if 6 <= sum(c in DIGITS for c in value) <= 20 else None


def login_after(text: str, at: int) -> tuple[int, int] | None:
    """The user part behind ``://``: up to an at-sign that a host follows."""
    end = run_end(text, at, len(text), LOCAL | frozenset(":"))
    return (at, end) if at < end < len(text) - 1 and text[end] == "@" and text[end + 1] in LABEL else None


def _anchors():
    import ahocorasick
    found = ahocorasick.Automaton()
    for a in ("@", "+", "://"):
        found.add_word(a, (a, len(a)))
    for d in string.digits:
        found.add_word(d, ("digit", 1))
    for cue in CUES:
        found.add_word(cue, (cue, len(cue)))
    found.make_automaton()
    return found


def find_spans(text: str, anchors) -> list[tuple[str, int, int]]:
    """All spans of a text, by kind as listed, then start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    floor = dict.fromkeys(KINDS, 0)  # no span of a kind begins before the end of the last match of that kind
    tried_ip = 0
    # A-Z in lower case: places stay the same, and a cue is found however it is spelled.
    for last, (anchor, size) in anchors.iter(text.lower() if text.isascii() else text.translate(LOWER)):
        at = last + 1 - size
        if anchor == "digit":
            if at >= floor["card"]:
                end = digits_from(text, at)
                floor["card"] = end
                if end - at >= 16:
                    digits = [c for c in text[at:end] if c in DIGITS]
                    if 16 <= len(digits) <= 19 and luhn("".join(digits)):
                        spans["card"].append((at, end))
            if at >= tried_ip:
                got = ip_from(text, at)
                if got is None:
                    tried_ip = run_end(text, at, len(text), DIGITS)
                else:
                    tried_ip = got[0]
                    if got[1]:
                        spans["ip"].append((at, got[0]))
        elif anchor == "@":
            got = email_at(text, at, floor["email"])
            if got:
                spans["email"].append(got)
                floor["email"] = got[1]
        elif anchor == "+":
            got = phone_from(text, at) if at >= floor["phone"] else None
            if got:
                floor["phone"] = got[0]
                if 8 <= got[1] <= 15:
                    spans["phone"].append((at, got[0]))
        elif anchor == "://":
            got = login_after(text, last + 1) if at >= floor["login"] else None
            if got:
                spans["login"].append(got)
                floor["login"] = got[1]
        elif at >= floor["account"] and not (at and text[at - 1] in LETTERS_DIGITS):
            got = account_after(text, anchor, last + 1)
            if got:
                spans["account"].append(got)
                floor["account"] = got[1]
    return [(k, a, b) for k in KINDS for a, b in spans[k]]


def find_personal_data(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: the spans of personal data in the whole text."""
    @F.arrow_udf(SPANS)
    def spans(texts):
        import pyarrow as pa
        anchors = worker_cache("pii_anchors", _anchors)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        rows = ([{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t.as_py(), anchors)] for t in texts)
        return pa.array(list(rows), kind)

    return df.withColumn(out, spans(whole_text(text)))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the one that begins first counts."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
            at = end
    return "".join(parts + [text[at:]])


ship(__name__)
