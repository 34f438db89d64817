"""Live credentials in code, configuration and logs: find and cut them out."""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.automaton import BEYOND, Automaton

UPPER, LOWER, DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALNUM, HEX = UPPER + LOWER + DIGIT, DIGIT + "abcdefABCDEF"
PLACEHOLDER = "[REDACTED]"
#: Characters after a token's prefix that the automaton itself checks. All of them would multiply its states (a token may
#: begin inside another's characters, at every count), so the grammar of the format checks the rest.
FIRST = 2

# Public token formats (prefix, further characters, least number of them).
TOKEN_FORMATS = [
    ("AKIA", UPPER + DIGIT, 16), ("ASIA", UPPER + DIGIT, 16), ("ghp_", ALNUM, 36), ("gho_", ALNUM, 36), ("ghu_", ALNUM, 36), ("ghs_", ALNUM, 36),
    ("ghr_", ALNUM, 36), ("github_pat_", ALNUM + "_", 22), ("glpat-", ALNUM + "_-", 20), ("npm_", ALNUM, 36), ("xoxb-", ALNUM + "-", 10),
    ("xoxp-", ALNUM + "-", 10), ("xoxa-", ALNUM + "-", 10), ("xoxr-", ALNUM + "-", 10), ("xoxs-", ALNUM + "-", 10), ("xapp-", ALNUM + "-", 20),
    ("sk_live_", ALNUM, 16), ("rk_live_", ALNUM, 16), ("sk_test_", ALNUM, 16), ("sk-", ALNUM + "_-", 20), ("AIza", ALNUM + "_-", 35), ("ya29.", ALNUM + "_-", 20),
    ("hf_", ALNUM, 30), ("pypi-", ALNUM + "_-", 40), ("SG.", ALNUM + "_-.", 40), ("dop_v1_", HEX, 60), ("shpat_", HEX, 32), ("dckr_pat_", ALNUM + "_-", 20),
    ("eyJ", ALNUM + "_-", 8),
]
LEAST = {p: n for p, _, n in TOKEN_FORMATS}
# Names whose value is a credential.
PASS_NAMES = ["password", "passwd", "passphrase", "passcode", "pwd", "pass", "passwort", "kennwort", "senha", "contraseña", "contrasena", "motdepasse", "mot_de_passe", "mdp", "пароль", "密码", "口令"]
OTHER_NAMES = ["secret", "token", "credential", "credentials", "auth"]
KEY_OWNERS = ["api", "access", "secret", "private", "auth", "account", "shared", "signing", "encryption", "master", "service", "client", "app", "admin", "webhook"]
CALLS = ["login", "authenticate", "signin", "sign_in", "connect", "log_in"]
# Words that stand for a credential and are none.
STAND_INS = [
    "password", "passwd", "secret", "token", "changeme", "change_me", "change-me", "example", "placeholder", "dummy", "redacted", "masked", "hidden", "removed",
    "none", "null", "nil", "true", "false", "undefined", "required", "optional", "string", "todo", "tbd", "unset", "empty", "foobar", "xxx", "value", "test",
    "your", "my", "fake", "sample", "insert", "replace", "notasecret", "omitted", "censored", "filtered", "encrypted", "hashed",
]

_STANDS = re.compile(
    r"(?i)(?:[^a-z0-9]*(?:" + "|".join(STAND_INS) + r")(?:[^a-z0-9]+.*)?|.*(?:redacted|changeme|placeholder|your[_-]|[_-]here\b|xxxx|\*\*\*|example).*|.*\.\.\.)$", re.S
)
_REFERENCE = re.compile(
    r"(?s)(?:\$\{.*|\$\(.*|\$[A-Za-z_]\w*|<.*|\{.*|\[.*|%\(.*|%[A-Z_]+%|\*+|[xX*•.#_\-]+|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|![A-Za-z_]+(?:\s.*)?|@.*|~?/.*|\.{1,2}/.*|[a-z]+://.*|(?:vault|secret|ref|file|env|arn|op|ssm|sops|aws-sm|gcp-sm|keyring):.*"
    r"|(?:os|process|config|settings|env|self|this|ctx|context|args|opts|options|request|req|params|secrets|vault|conf|cfg|environ)[.\[].*)$"
)
_CODE = re.compile(r"[A-Za-z_]\w*(?:(?:\.|->|::)[A-Za-z_]\w*)*\s*[(\[]|[A-Za-z_]\w*(?:(?:\.|->|::)[a-z_]+)+$")
_FILE = re.compile(r"[\w./-]+\.(?:py|ts|js|go|rs|json|ya?ml|txt|pem|key|env|md|html?)")
#: What a field for a password says to its reader: a whole value, or a word of a value with blanks.
_MESSAGE = re.compile(r"(?i)\b(?:password|passphrase|passcode|required|missing|invalid|incorrect|wrong|must|cannot|characters?|please|enter|forgot(?:ten)?|expired|mismatch|failed|empty)\b")
#: Where a value after a flag ends its command or goes on with a flag or shell operator; commands whose user has a group.
_AFTER_FLAG = re.compile(r"""["']?[ \t]*(?:$|[|;&>\\)`]|[ \t]-)""", re.M)
#: Letters that read as a name of code.
_NAMED = re.compile(r"[A-Z]+(?:[_\-][A-Z]+)*|_*[A-Za-z]?[a-z]+(?:[_.\-]?(?:[A-Z][a-z]+|[a-z]+))*[A-Z]*")
_GROUPED = re.compile(r"\b(?:docker|podman|nerdctl|kubectl|chown|install|setpriv)\b")
_SQL = [["with"], ["encrypted"], ["identified"], ["set"], ["user"]]
_HASHED = re.compile(r"(?:\$2[abxy]?\$|\$argon2|\$[156]\$|\{?(?:bcrypt|pbkdf2|scrypt|sha\d*|md5|ssha)\b|sha\d+[-:])", re.I)

_OP = re.compile(
    r"""(?P<lead>["'\]]{0,2}[ \t]*(?::[ \t]*[A-Za-z_][\w\[\], |.]*[ \t]*=(?!=)|=>|:=|=(?!=)|:(?!:))|["']?[ \t]*\{?[ \t]*\r?\n(?:[ \t]*(?:type|description|sensitive)[^\n]*\n){0,3}[ \t]*["']?(?:default|value)["']?[ \t]*[:=]|["']?>|["'][ \t]+value=)[ \t]*(?:[bru]?(?P<q>\"{3}|'{3}|\\?["'`]))?"""
)
_BARE = re.compile(r"""[^\s"'`<>]+""")
_FLAG = re.compile(r"""[ \t]+(?P<q>["']?)(?=\S)""")
_CALL = re.compile(r"""\(\s*[bru]?(["'])[^"'\n]*\1\s*,\s*(?:\w+\s*=\s*)?[bru]?(["'])(?P<v>[^"'\n]+)\2""")
_USER = re.compile(r"""(?:-u|--user)[ =]+["']?[^\s:"']+:(?P<v>[^\s"']+)""")
_BASIC = re.compile(r"""(?i)basic[ \t]+(?P<v>[A-Za-z0-9+/_\-]{8,}={0,2})""")
_BEARER = re.compile(r"""(?i)(?:bearer|token|apikey)[ \t]+(?P<v>[A-Za-z0-9._~+/\-]{12,}=*)""")
_URL = re.compile(r"""://(?P<u>[^\s/:@"'<>]*):(?P<v>[^\s/"'<>]+?|[^\s"'<>]+?)@(?=[\w\[.\-]+)""")
_ARMOR = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?P<v>(?:[A-Za-z0-9+/=\s:,\-]|\\[nr])*?)(?=-----END|(?![A-Za-z0-9+/=\s:,\\\-])|\Z)")
#: The same in JSON: the object behind "data", of strings only, and its pairs.
_JSON_DATA = re.compile(r'''"data"\s*:\s*\{(?P<b>[^{}]*)\}''')
_JSON_PAIR = re.compile(r'''"[\w.\-]+"\s*:\s*"(?P<v>[A-Za-z0-9+/_\-]{8,}={0,2})"''')
_DATA = re.compile(r"(?m)^(?P<i>[ \t]*)data:[ \t]*\r?\n(?P<b>(?:(?P=i)[ \t]+\S[^\n]*\n?)+)")
_PAIR = re.compile(r"""(?m)^[ \t]+["']?[\w.\-]+["']?:[ \t]*["']?(?P<v>[A-Za-z0-9+/_\-]{8,}={0,2})["']?[ \t]*$""")
_KEY_NAME = re.compile(r"(?i)(?:" + "|".join(KEY_OWNERS) + r")[_\-. ]?(?:key|key[_\-]?id)$")
_SETTERS = ("env", "arg", "set", "setx")


_ASCII = re.compile(r"[\x00-\x7f]*")


def _word(text: str, case: bool = False) -> list[tuple[frozenset[str], int, int]]:
    return [(frozenset({c} if case else {c.lower(), c.upper()}), 1, 1) for c in text if ord(c) < 128]


def _rules() -> list[tuple[str, str, list[tuple[frozenset[str], int, int]]]]:
    """(rule, anchor, pattern): what the automaton looks for; a rule's grammar then delimits the value."""
    rules = [("token", p, [*_word(p, case=True), (frozenset(c), FIRST, FIRST)]) for p, c, _ in TOKEN_FORMATS]
    rules.append(("armor", "-----BEGIN", _word("-----BEGIN ", case=True)))
    free = frozenset(chr(c) for c in range(33, 127)) - set("/@\"'<>")
    rules.append(("url", "://", [*_word("://"), (free, 2, 2)]))
    apart = frozenset(chr(c) for c in range(1, 128)) - set(ALNUM + "_")
    for name in [*PASS_NAMES, *OTHER_NAMES, "key", "key_id", "key-id", "keyid"]:
        head = _ASCII.match(name).group()  # the automaton sees a name up to its first letter beyond ASCII; the grammar reads the rest
        # one without any ASCII letter is seen by its length up to the sign that a value follows
        sign = [(frozenset({BEYOND}), len(name), len(name)), (frozenset(" \t\"'"), 0, 3), (frozenset(":="), 1, 1)]
        rules.append(("name", name, [*_word(head), (apart, 1, 1)] if head == name else _word(head) or sign))
    rules += [("call", c, [*_word(c), (frozenset("("), 1, 1)]) for c in CALLS]
    rules += [("user", f, [(frozenset(" \t\n"), 1, 1), *_word(f, case=True), (frozenset(" ="), 1, 1)]) for f in ("-u", "--user")]
    rules += [("basic", "basic", [*_word("basic"), (frozenset(" \t"), 1, 1), (frozenset(ALNUM), 1, 1)])]
    rules += [("bearer", b, [*_word(b), (frozenset(" \t"), 1, 1), (frozenset(ALNUM), 1, 1)]) for b in ("bearer",)]
    rules += [("identified", "identified by", _word("identified by "))]
    gap = (frozenset(" \t\"'"), 0, 3)
    rules += [("manifest", "kind", [*_word("kind", case=True), gap, *_word(":"), gap, *_word("Secret", case=True)])]
    return rules


_numbered = lru_cache(1)(_rules)


@lru_cache(1)
def _machine() -> tuple[list, Automaton]:
    return _numbered(), Automaton([p for _, _, p in _numbered()])


def _before(text: str, at: int, count: int) -> list[str]:
    """The last ``count`` words, parted by white space, before a place that white space stands before; in lower case."""
    out: list[str] = []
    while len(out) < count:
        stop = at
        while stop and text[stop - 1].isspace():
            stop -= 1
        if stop in (0, at):
            break
        at = stop
        while at and not text[at - 1].isspace():
            at -= 1
        out.append(text[at:stop].lower())
    return out[::-1]


def _logs_in(text: str, at: int) -> bool:
    """Whether a value follows the name at ``at`` without a sign: in a netrc entry (``machine h login u password p``, in lines
    or not) or where a setting is made (``ENV NAME value``)."""
    words = _before(text, at, 2)
    if len(words) == 2 and words[0] in ("machine", "login", "account"):
        return True
    return words[-1:] != [] and words[-1] in _SETTERS and text[text.rfind("\n", 0, at) + 1 : at].strip().lower() == words[-1]


def _decoded(value: str) -> str | None:
    try:
        raw = base64.b64decode(value + "=" * (-len(value) % 4), altchars=b"-_" if set(value) & set("-_") else None, validate=True)
        text = raw.decode("utf-8")
    except (binascii.Error, ValueError):
        return None
    text = text.rstrip("\r\n")  # echo pw | base64
    return text if text and (text.isprintable() or _ARMOR.search(text)) else None


def is_literal(value: str, quoted: bool, password: bool, proven: bool = False) -> bool:
    """Whether a value that stands for a credential is one, not a reference, a stand-in, a mask, a hash or code.

    Where the grammar around it has ``proven`` that a password stands there, letters alone or a passphrase will do.
    """
    v = value.strip()
    if len(v) < 5 or _REFERENCE.match(v) or _STANDS.match(v) or _HASHED.match(v) or len(set(v)) < 4:
        return False
    if proven:
        said = _MESSAGE.search(v) if any(c.isspace() for c in v) else _MESSAGE.fullmatch(v)
        return not (said or not quoted and _CODE.match(v) or _FILE.fullmatch(v))
    if any(c.isspace() for c in v):
        return False
    odd = password and any(c in v for c in "!?%^*@#&+~") and any(c.isupper() for c in v) and any(c.islower() for c in v)
    if not quoted and (_CODE.match(v) or not (odd or any(c in v for c in DIGIT))):
        return False
    if v.isdigit():
        return password and quoted and len(v) >= 6
    digits, marks = any(c.isdigit() for c in v), any(not c.isalnum() and c not in "_-./" for c in v)
    mixed = any(c.isupper() for c in v[1:]) and any(c.islower() for c in v)
    if not (digits or marks or mixed and len(v) >= 12):
        return False
    if _FILE.fullmatch(v):
        return False
    return password or len(v) >= 12 or not v.isalpha()


def find_in(text: str, ends: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Distinct spans of credentials in ``text``, given the automaton's (end, pattern) hits in it."""
    rules = _numbered()
    spans: set[tuple[int, int]] = set()

    def valued(lead: re.Match, password: bool, url: bool, proven: bool = False) -> None:
        begin, quote = lead.end(), lead.group("q")
        if quote:
            stop = text.find(quote, begin)
            line = text.find("\n", begin)
            if stop < 0 or (len(quote) < 3 and 0 <= line < stop):
                return
            value = text[begin:stop]
        elif lead.groupdict().get("lead", "").endswith(">") and not lead.group("lead").endswith("=>"):
            stop = text.find("<", begin)
            value = text[begin:stop] if stop > 0 else ""
        else:
            m = _BARE.match(text, begin)
            if not m:
                return
            value = m.group()
            if url:
                value = value.split("&")[0]
            value = value.rstrip(",;)}]") if not password or value[-1:] in ",;" else value
        if is_literal(value, bool(quote), password, password and proven):
            spans.add((begin, begin + len(value)))

    for end, number in ends:
        rule, anchor, pattern = rules[number]
        if rule == "token":
            begin, least = end - len(anchor) - FIRST, LEAST[anchor]
            if begin and (text[begin - 1].isalnum() or text[begin - 1] == "_" and anchor != "eyJ"):
                continue
            more = pattern[-1][0] | ({"."} if anchor == "eyJ" else set())
            while end < len(text) and text[end] in more:
                end += 1
            value = text[begin:end].rstrip(".-")
            if len(value) < len(anchor) + least or anchor == "eyJ" and value.count(".") != 2 or _STANDS.match(value) or len(set(value[len(anchor) :])) < 6:
                continue
            spans.add((begin, begin + len(value)))
        elif rule == "armor":
            begin = text.rfind("-----BEGIN", 0, end)
            if (m := _ARMOR.match(text, begin)) and len(re.sub(r"\\[nr]|\s", "", m.group("v"))) >= 24:
                v = m.group("v")
                spans.add((m.start("v") + len(v) - len(v.lstrip()), m.start("v") + len(v.rstrip())))
        elif rule == "url":
            begin = text.rfind("://", 0, end)
            if (m := _URL.match(text, begin)) and is_literal(m.group("v"), True, True, True):
                spans.add(m.span("v"))
        elif rule == "name":
            if anchor.isascii():
                begin = stop = end - 1
            else:
                head = _ASCII.match(anchor).group()
                least = max(0, end - len(anchor) - 4)
                begin = end if head else least + text[least:end].lower().rfind(anchor)
                rest = anchor[len(head) :]
                rest = next((r for r in (rest, unicodedata.normalize("NFD", rest)) if text[begin : begin + len(r)].lower() == r), "")
                stop = begin + len(rest)
                if not rest or text[stop : stop + 1].isalnum() or text[stop : stop + 1] == "_":
                    continue
            while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_-."):
                begin -= 1
            name = text[begin:stop].lower()
            password = anchor in PASS_NAMES
            if anchor.startswith("key"):
                if not _KEY_NAME.search(name):
                    continue
            elif not password and re.search(r"(?:public|hash|pad|eos|bos|unk|mask|sep|cls)[_-]?token$", name):
                continue
            elif password and anchor == "pass" and not re.fullmatch(r"(?:.*[_\-.])?pass|[a-z]*[a-z]Pass", text[begin:stop], re.I):
                continue
            url = begin > 0 and text[begin - 1] in "?&"
            if lead := _OP.match(text, stop):
                shell = text[begin:stop].isupper() and lead.group() == "="
                bare = not lead.group("q") and _BARE.match(text, lead.end())
                alone = bare and not text[text.rfind("\n", 0, begin) + 1 : begin].strip() and text[bare.end() : bare.end() + 1] in ("", "\r", "\n")
                random = alone and len(bare.group()) >= 8 and bare.group().lower() != bare.group() and not _NAMED.fullmatch(bare.group())
                valued(lead, password, url, shell or bool(random or lead.group("q")))
            elif text[begin:stop].startswith("--") or _logs_in(text, begin) or (password and text[stop : stop + 2] in (" '", ' "')):
                if lead := _FLAG.match(text, stop):
                    bare = _BARE.match(text, lead.end())
                    flag = text[begin:stop].startswith("--") and (lead.group("q") or bare and bare.group()[-1] not in ".:!?" and _AFTER_FLAG.match(text, bare.end()))
                    valued(lead, password, False, bool(flag) or bool(lead.group("q") and _before(text, begin, 1)[:1] in _SQL))
        elif rule == "call":
            if (m := _CALL.match(text, end - 1)) and is_literal(m.group("v"), True, True, anchor != "connect"):  # a host and a database too
                spans.add(m.span("v"))
        elif rule == "user":
            line = text[text.rfind("\n", 0, end) + 1 : end]
            if (m := _USER.match(text, end - len(anchor) - 1)) and is_literal(m.group("v"), True, True, not _GROUPED.search(line)):
                spans.add(m.span("v"))
        elif rule == "basic":
            m = _BASIC.match(text, end - 7)
            inner = m and _decoded(m.group("v"))
            if inner and ":" in inner and is_literal(inner.split(":", 1)[1], True, True, True):
                spans.add(m.span("v"))
        elif rule == "bearer":
            m = _BEARER.match(text, end - len(anchor) - 2)
            if m and any(c.isdigit() for c in m.group("v")) and is_literal(m.group("v"), False, False):
                spans.add(m.span("v"))
        elif rule == "identified":
            if lead := _FLAG.match(text, end - 1):
                valued(lead, True, False, True)
        elif rule == "manifest":
            for data, pair in ((_DATA, _PAIR), (_JSON_DATA, _JSON_PAIR)):
                for block in data.finditer(text):
                    for m in pair.finditer(block.group("b")):
                        inner = _decoded(m.group("v"))
                        if inner and (_ARMOR.search(inner) or is_literal(inner, True, True)):
                            spans.add((block.start("b") + m.start("v"), block.start("b") + m.end("v")))
    return sorted(spans)


def redact(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with a placeholder in place of every span; overlapping spans count as one."""
    out, at = [], 0
    for begin, end in spans:
        if begin >= at:
            out += [text[at:begin], PLACEHOLDER]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find_credentials(df: DataFrame, columns: dict[str, str], keep: list[str], redacted: bool = False) -> DataFrame:
    """Fields with at least one credential: columns ``keep``, ``field_name``, ``found`` (spans) and, if asked, ``redacted``.

    ``columns`` maps the names to report to the columns to read. One automaton, made of the token formats, key armor,
    connection strings and assignment names, is run over overlapping chunks of all texts side by side (Arrow batches,
    no shuffle); its hits are distinct absolute places, where the grammar of the rule delimits the value. Values that
    are references, stand-ins, masks, hashes or code are no credentials. Spans are offsets in code points,
    ``[begin, end)``; redaction replaces nothing else, so all other code keeps its form.

    Null and empty fields never match; texts of any length are read whole; rows repeated in ``df`` are repeated in the
    result. Other columns are not read.
    """
    source = df.select(*keep, F.explode(F.array(*(F.struct(F.lit(n).alias("field_name"), F.col(c).alias("t")) for n, c in columns.items()))).alias("_f"))
    source = source.select(*keep, "_f.field_name", F.col("_f.t").alias("_t")).where(F.length("_t") > 0)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + ", found array<struct<begin: int, end: int>>"
    schema += ", redacted string" if redacted else ""
    names = [*source.columns[:-1], "found", *(["redacted"] if redacted else [])]
    spans_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    share = df.sparkSession.sparkContext.broadcast(_machine()[1])  # a few thousand states, fixed by the rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = share.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            hits: dict[int, list[tuple[int, int]]] = {}
            for t, end, pattern in machine.scan(texts):
                hits.setdefault(t, []).append((end, pattern))
            spans = {t: s for t, ends in hits.items() if (s := find_in(texts[t], ends))}
            rows = sorted(spans)
            if rows:
                part = batch.take(pa.array(rows))
                found = pa.array([[{"begin": a, "end": b} for a, b in spans[t]] for t in rows], spans_type)
                cut = [pa.array([redact(texts[t], spans[t]) for t in rows], pa.string())] if redacted else []
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found, *cut], names=names)

    return source.mapInArrow(run, schema)
