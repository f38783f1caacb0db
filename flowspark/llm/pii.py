"""Personal data by anchor expansion: an Aho-Corasick pass finds anchors, local parsers find boundaries.

Anchors are at-signs, plus signs before digits, digits, schemes, and identifier cues. Each anchor starts a
deterministic parser of its kind that expands to both sides and validates. Kinds in this order:

* email, ip, card, phone: the base kinds, equal to leftmost, non-overlapping pattern matches;
* iban: two letters and digits with a valid mod-97 checksum, where a bank account cue comes before (see REACH); it
  ends with a word, where the country's numbers end or else, from the longest on, where the checksum holds;
* ssn: three groups of digits (3-2-4, no group of zeros only, area neither 666 nor 9xx) after a cue; of several
  after one cue, those right after "not" are left out, but never the first;
* account, routing, bic, passport, licence: what stands right after its cue, of the form of ``AFTER`` (an account number
  has 6 to 17 digits, a routing number 9 with a valid checksum, a bank code 8 or 11 letters and digits, the others at least four digits);
* uri: an address with its scheme: name://, an optional user and password, a host, port and path; mailto: with its
  addresses; tel:, sms:, fax: and callto: with a number of 6 to 15 digits, plus sign or not;
* secret: what opens an account: the value given to a password, token or key (8 characters or more, letters and digits
  both, after "=" or ":", or 16 after "bearer"), and keys whose issuers publish their form (``KEYS``), after no cue.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order of all reports.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "uri", "account", "routing", "bic", "passport", "licence", "secret")
BASE_KINDS = KINDS[:4]
#: Cues (lower case) that announce an identifier, by kind.
CUES = {"iban": ("iban",), "ssn": ("ssn", "social security")}
#: Cues (lower case) of identifiers that stand right after them, by kind.
NEAR_CUES = {
    "account": ("account", "acct", "a/c", "konto", "kontonummer", "compte", "cuenta"),
    "routing": ("routing", "aba"),
    "bic": ("bic", "swift"),
    "passport": ("passport", "reisepass", "passeport", "pasaporte"),
    "licence": ("driver license", "driver's license", "driver licence", "driving licence", "driver's licence", "permis de conduire", "permiso de conducir"),
}
#: Words and marks that may stand between such a cue and its identifier, and the identifiers' forms.
BETWEEN = r"(?i:[\x20\t:#.=-]|(?:numbers?|nummer|no|nr|num|n°|nº|number|code|id|is|transit|num.ro|de|del|du)(?![A-Za-z0-9])){1,16}"
AFTER = {
    "account": r"[0-9](?:[\x20-]?[0-9]){5,16}(?![0-9A-Za-z])",
    "routing": r"[0-9]{9}(?![0-9A-Za-z])",
    "bic": r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?(?![0-9A-Za-z])",
    "passport": r"[A-Z]{0,2}(?=(?:[A-Z]*[0-9]){4})[A-Z0-9]{6,9}(?![0-9A-Za-z])",
    "licence": r"[A-Z]{0,2}(?=(?:[A-Z-]*[0-9]){4})[A-Z0-9][A-Z0-9-]{4,16}[A-Z0-9](?![0-9A-Za-z])",
}
#: Cues (lower case) of values that open an account.
SECRET_CUES = ("password", "passwd", "passphrase", "pwd", "passwort", "mot de passe", "contraseña", "token", "secret", "api key", "api_key", "api-key", "apikey",
               "access key", "access_key", "accesskey", "private key", "private_key", "bearer")
#: Keys of a published form, by how they begin.
KEYS = {
    "AKIA": r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "ASIA": r"ASIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "AIza": r"AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
    "ghp_": r"ghp_[A-Za-z0-9]{36,}",
    "gho_": r"gho_[A-Za-z0-9]{36,}",
    "glpat-": r"glpat-[A-Za-z0-9_-]{20,}",
    "xoxb-": r"xoxb-[0-9A-Za-z-]{20,}",
    "xoxp-": r"xoxp-[0-9A-Za-z-]{20,}",
    "sk_live_": r"sk_live_[A-Za-z0-9]{16,}",
    "-----BEGIN": r"-----BEGIN (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----(?:[\r\n]+[A-Za-z0-9+/=]{16,})*(?:[\r\n]+[A-Za-z0-9+/=]+)?(?:[\r\n]*-----END (?:[A-Z]{2,12} ){0,3}PRIVATE KEY-----)?",
}
#: Schemes (lower case) without slashes, and whether a number or addresses follow.
SCHEMES = {"tel:": "number", "sms:": "number", "fax:": "number", "callto:": "number", "mailto:": "addresses"}
#: An identifier starts on the line of its cue, or within this many characters after the cue.
REACH = 64
#: Fixed values (ISO 13616): letters and digits of an account number, by country.
IBAN_LENGTHS = {country: length for length, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}")
_IBAN_BODY = re.compile(r"(?:\x20?[A-Za-z0-9]){11,30}")
_WORD_END = re.compile(r"(?<=[A-Za-z0-9])(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9])(?!000|666|9)[0-9]{3}([\x20-])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9])")
_SSN_CUE = re.compile("|".join(CUES["ssn"]), re.IGNORECASE | re.ASCII)
_NOT = re.compile(r"(?:\bnot|n't)\x20+$", re.IGNORECASE | re.ASCII)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*")
_SCHEME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_USER = re.compile(r"[A-Za-z0-9._~!$&'()*+,;=:%@-]*@")
_HOST = re.compile(r"\[[0-9A-Fa-f:.]{2,45}\]|[^\W_](?:[\w-]*\w)?(?:\.[^\W_](?:[\w-]*\w)?)*")
_PORT = re.compile(r":([0-9]{1,5})(?![0-9])")
_PATH = re.compile(r"[/?#][\w.~!$&'()*+,;=:@%/?#\[\]-]*")
_ADDRESSES = re.compile(r"[\w.!$&'*+/=^`{|}~%-]+(?:@|%40)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?:(?:,|%2[Cc])[\w.!$&'*+/=^`{|}~-]+(?:@|%40)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)*")
_NUMBER = re.compile(r"\x20?\+?(?:\(\x20?)?[0-9](?:[\x20().\/-]{0,2}[0-9])*")
_NUMBER_END = re.compile(r"(?<=[0-9])(?![0-9])")
_NUMBER_MORE = re.compile(r"(?:;[A-Za-z-]+=[\w.+%:-]*\w)+")

_AFTER = {kind: re.compile(f"{BETWEEN}({form})") for kind, form in AFTER.items()}
_SECRET = re.compile(r"""["']?[\x20\t]*(?:=>|:=|[=:])[\x20\t]*["']?((?=[^\s"']{0,63}[0-9])(?=[^\s"']{0,63}[A-Za-z])[^\s"'<>,;]{8,})""")
_BEARER = re.compile(r"[\x20\t]+((?=[^\s]{0,63}[0-9])[A-Za-z0-9_.~+/=-]{16,})")
_KEYS = {head.lower(): re.compile(form) for head, form in KEYS.items()}
_WORD_CHARS = re.compile(r"[A-Za-z0-9]")

_automaton = None


def automaton():
    """The anchors: '@', '+', every digit, schemes and cues, for text with A to Z in lower case."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for mark in "@+":
            _automaton.add_word(mark, (mark, 1))
        for digit in "0123456789":
            _automaton.add_word(digit, ("digit", 1))
        for scheme, kind in {"://": "host", **SCHEMES}.items():
            _automaton.add_word(scheme, (kind, len(scheme)))
        for kind, cues in CUES.items():
            for cue in cues:
                _automaton.add_word(cue, (kind, len(cue)))
        for kind, cues in NEAR_CUES.items():
            for cue in cues:
                _automaton.add_word(cue, (kind, len(cue)))
        for cue in (*SECRET_CUES, *_KEYS):
            _automaton.add_word(cue, ("secret", len(cue)))
        _automaton.make_automaton()
    return _automaton


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _iban_valid(text: str) -> bool:
    plain = text.replace(" ", "").upper()
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _iban_ends(text: str, start: int, limit: int) -> tuple[list[int], list[int]]:
    """Where valid account numbers whose country and check digits are at ``start`` end, ``limit`` at most: those of
    the country's length, and others, longest first."""
    body = _IBAN_BODY.match(text, start + 4)
    ends = [m.end() for m in _WORD_END.finditer(text, body.start(), body.end() + 1) if m.end() <= min(body.end(), limit)] if body else []
    lengths = {end: end - start - text.count(" ", start, end) for end in reversed(ends)}
    valid = [end for end, n in lengths.items() if n >= 15 and _iban_valid(text[start:end])]
    usual = IBAN_LENGTHS.get(text[start:start + 2].upper())
    return [end for end in valid if lengths[end] == usual], [end for end in valid if lengths[end] != usual]


def _ibans(text: str, start: int, limit: int) -> list[tuple[int, int]]:
    """Account numbers that start from ``start`` to ``limit``, sorted; those of their country's length come before others."""
    heads = [m.start() for m in _IBAN_HEAD.finditer(text, start, limit + 4)]
    usual: list[tuple[int, int]] = []
    others: list[tuple[int, int]] = []
    for head in heads:
        if (not usual or head >= usual[-1][1]) and (ends := _iban_ends(text, head, len(text))[0]):
            usual.append((head, ends[0]))
    for head in heads:
        i = bisect_right(usual, (head, len(text)))
        if (not i or head >= usual[i - 1][1]) and (not others or head >= others[-1][1]):
            ends = _iban_ends(text, head, usual[i][0] if i < len(usual) else len(text))[1]
            others += [(head, end) for end in ends[:1]]
    return sorted(usual + others)


def _ssns(text: str, start: int, limit: int) -> list[tuple[int, int]]:
    """Groups of digits of the right form that start from ``start`` to ``limit``, sorted, without those that are
    said not to be one after another number, with no cue between."""
    found, before = [], None
    for m in _SSN.finditer(text, start, limit + 12):
        if m.start() <= limit:
            if before is None or not _NOT.search(text[max(before, m.start() - 12):m.start()]) or _SSN_CUE.search(text, before, m.start()):
                found.append(m.span())
            before = m.end()
    return found


def _trimmed(text: str, start: int, end: int) -> int:
    """The end of an address without the sentence's marks: a closing bracket stays if its opening one is inside."""
    depth = {mark: text.count(mark, start, end) for mark in "()[]"}
    while end > start and (text[end - 1] in ".,;:!?'*" or text[end - 1] in ")]" and depth[text[end - 1]] > depth["(" if text[end - 1] == ")" else "["]):
        end -= 1
        if text[end] in ")]":
            depth[text[end]] -= 1
    return end


def _host_address(text: str, at: int, least: int) -> tuple[int, int] | None:
    """The address whose scheme ends before the '://' at ``at``, from ``least`` on."""
    start = at
    while start > least and text[start - 1] in _SCHEME_CHARS:
        start -= 1
    scheme = _SCHEME.search(text, start, at)
    user = _USER.match(text, at + 3)
    host = _HOST.match(text, user.end() if user else at + 3)
    if scheme is None or host is None or len(host[0]) > 253:
        return None
    labels = host[0].split(".")
    quad = host[0][0] != "[" and all(label.isdecimal() for label in labels)
    if any(len(label) > 63 for label in labels) or quad and (len(labels) != 4 or any(int(label) > 255 for label in labels)):
        return None
    end = host.end()
    if (port := _PORT.match(text, end)) and int(port[1]) <= 65535:
        end = port.end()
    if path := _PATH.match(text, end):
        end = _trimmed(text, end, path.end())
    return scheme.start(), end


def _plain_address(text: str, start: int, at: int, kind: str) -> tuple[int, int] | None:
    """The address of a scheme without slashes that begins at ``start`` and ends before ``at``."""
    if start and text[start - 1].isalnum():
        return None
    if kind == "addresses":
        if (m := _ADDRESSES.match(text, at)) is None:
            return None
        more = _PATH.match(text, m.end()) if text[m.end():m.end() + 1] == "?" else None
        return start, _trimmed(text, m.end(), more.end()) if more else m.end()
    if (m := _NUMBER.match(text, at)) is None:
        return None
    # The number is the first group if that has the length of one, else as many groups as one can have.
    ends = [(e.end(), len(_digits(text[at:e.end()]))) for e in _NUMBER_END.finditer(text, at, min(m.end(), at + 64) + 1) if e.end() <= m.end()]
    fitting = [end for end, n in ends if 6 <= n <= 15]
    space = text.find(" ", at + 1, m.end())
    first = [end for end, n in ends if 7 <= n <= 15 and end == space]
    if not fitting:
        return None
    end = first[0] if first else fitting[-1]
    more = _NUMBER_MORE.match(text, end)
    return start, more.end() if more else end


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end exclusive; code points) of each kind of ``KINDS``, sorted, non-overlapping in a kind."""
    spans: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    done = dict.fromkeys(("email", "ip", "card", "phone", "run"), 0)
    reached, line_end = dict.fromkeys(CUES, 0), -1
    # Only A to Z change, so that all offsets stay.
    for last, (anchor, width) in automaton().iter(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
        if anchor == "digit":
            if last >= done["ip"] and (m := _QUAD.match(text, last)):
                # Matches start at the head of a digit run: the anchors come from the left.
                done["ip"] = m.end()
                if all(int(part) <= 255 if len(part) <= 20 else not part.strip("0") for part in m[0].split(".")):
                    spans["ip"].append(m.span())
            elif last >= done["ip"]:
                done["ip"] = _run_end(text, last)
            if last >= done["card"]:
                m = _DIGITS.match(text, last)
                done["card"] = m.end() if m else last + 1
                if m and 16 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
                    spans["card"].append(m.span())
        elif anchor == "@":
            start = last
            while start > done["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                spans["email"].append((start, m.end()))
                done["email"] = m.end()
        elif anchor == "+":
            if last >= done["phone"] and (m := _PHONE.match(text, last)):
                done["phone"] = m.end()
                if 8 <= len(_digits(m[0])) <= 15:
                    spans["phone"].append(m.span())
        elif anchor in ("host", "number", "addresses"):
            start, least = last - width + 1, spans["uri"][-1][1] if spans["uri"] else 0
            if start >= least:
                span = _host_address(text, start, least) if anchor == "host" else _plain_address(text, start, last + 1, anchor)
                if span:
                    spans["uri"].append(span)
        elif anchor == "secret":
            start = last - width + 1
            # A cue inside a secret starts none: each character is read once.
            if (not spans[anchor] or start >= spans[anchor][-1][1]) and (span := _secret(text, start, last + 1)):
                spans[anchor].append(span)
        elif anchor in NEAR_CUES:
            span = _after_cue(text, last - width + 1, last + 1, anchor)
            if span and (not spans[anchor] or span[0] >= spans[anchor][-1][1]):
                spans[anchor].append(span)
        else:
            if last > line_end:
                line_end = text.find("\n", last)
                line_end = len(text) if line_end < 0 else line_end
            limit = min(len(text), max(line_end, last + 1 + REACH))
            start = max(last + 1, reached[anchor])
            if start <= limit:
                spans[anchor] += (_ibans if anchor == "iban" else _ssns)(text, start, limit)
                reached[anchor] = max(limit + 1, spans[anchor][-1][1] if spans[anchor] else 0)
    return spans


def _after_cue(text: str, start: int, end: int, kind: str) -> tuple[int, int] | None:
    """The identifier right after the cue at ``start`` to ``end``, which must be a word of its own (or with a plural s)."""
    if start and _WORD_CHARS.match(text[start - 1]):
        return None
    if text[end:end + 1] in ("s", "S"):
        end += 1
    m = _AFTER[kind].match(text, end)
    if m is None or kind == "routing" and sum(int(d) * w for d, w in zip(m[1], (3, 7, 1) * 3, strict=True)) % 10:
        return None
    return m.span(1)


def _secret(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The key that begins at ``start``, or the value given to the cue at ``start`` to ``end``, without the sentence's marks."""
    cue = text[start:end].lower()
    if cue in _KEYS:
        m = None if start and _WORD_CHARS.match(text[start - 1]) else _KEYS[cue].match(text, start)
        return m.span() if m else None
    m = (_BEARER if cue == "bearer" else _SECRET).match(text, end)
    if m is None:
        return None
    start, end = m.span(1)
    while text[end - 1] in ".:!?)]}":
        end -= 1
    return (start, end) if end - start >= 8 else None


def _run_end(text: str, at: int) -> int:
    """Where an address could start next if none starts in the digit run at ``at``."""
    end = at + 1
    while end < len(text) and "0" <= text[end] <= "9":
        end += 1
    return end


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in kinds for start, end in spans[kind])


def mask(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """``text`` with every span replaced by its kind in brackets; of overlapping spans the first gives the kind, and all are covered."""
    out, at = [], 0
    for start, end, kind in sorted((s, -e, k) for k, found in spans.items() for s, e in found):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, -end)
    return "".join(out) + text[at:]


def detect(docs: DataFrame, masked: bool = False) -> DataFrame:
    """(doc_id, n_ and each of ``KINDS``, n_spans (all kinds), base_spans, base_sha256, spans[, masked_text]) of each row,
    from its whole text.

    Null or empty text has no spans; its masked text is empty. Repeated rows get equal answers; other columns
    are left out; an empty table gives no rows. A regular expression's work on one run of characters bounds the
    cost, so very long texts take time in proportion to their length.
    """
    fields = [*(f"n_{k}" for k in KINDS), "n_spans"]
    schema = "doc_id long, " + ", ".join(f"{f} long" for f in fields) + ", base_spans string, base_sha256 string, spans string" + ", masked_text string" * masked

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [find(t) if t else dict.fromkeys(KINDS, []) for t in texts]
            base = [listed(s, BASE_KINDS) for s in found]
            columns = [batch.column("doc_id"), *(pa.array([len(s[k]) for s in found], pa.int64()) for k in KINDS), pa.array([sum(map(len, s.values())) for s in found], pa.int64()), pa.array(base, pa.string()),
                       pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()), pa.array([listed(s, KINDS) for s in found], pa.string())]
            if masked:
                columns.append(pa.array([mask(t or "", s) for t, s in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *fields, "base_spans", "base_sha256", "spans", *["masked_text"] * masked])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
