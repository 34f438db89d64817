"""Text functions, all built-in expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casewright.functions.patterns import matches

SEPARATOR = " :: "
# Patterns of credentials, in order; the second name is what reports show.
CREDENTIALS = [
    ("credential_assignment", r"(?i)\b(api[_-]?key|apikey|secret|password|passwd|auth[_-]?token|access[_-]?token)\b\s*[:=]\s*\S+"),
    ("openai_style_key", r"\bsk-[A-Za-z0-9_-]{8,}\b"),
    ("aws_access_key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{20,}\b"),
    ("private_key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
]
# Patterns of destructive commands.
DESTRUCTIVE = [
    ("posix_rm_rf_root", r"\brm\s+-[a-zA-Z]*[rf][a-zA-Z]*\s+/([^\w.-]|$)"),
    ("disk_format", r"(?i)\bmkfs\b|\bformat\s+c:"),
    ("windows_del_tree", r"(?i)\bdel\s+/[sq]\b|\brd\s+/s\b|\bRemove-Item\s+-Recurse\s+-Force\s+[A-Za-z]:\\"),
    ("forced_system_stop", r"(?i)\b(shutdown|reboot)\s+(-f|--force|now)\b"),
]
# Subject categories of failures, first match wins.
SUBJECTS = [
    (r"enoent|file.?not.?found|no.?such.?file|errno", "environment-error"),
    (r"permission.?denied|access.?denied|eacces", "environment-error"),
    (r"not a git repository", "environment-error"),
    (r"wrong.?cwd|working.?directory", "environment-error"),
    (r"syntax.?error|indentation.?error|invalid.?syntax", "build-failure"),
    (r"make.*fail|ninja.*fail|cmake.*fail|cargo.*fail", "build-failure"),
    (r"bom|utf-?8-sig|encoding", "configuration-error"),
    (r"jsondecodeerror|json.?decode|invalid.?json", "configuration-error"),
    (r"config.?error|missing.?key|unknown.?field", "configuration-error"),
    (r"module.?not.?found|import.?error|no.?module.?named", "dependency-error"),
    (r"version.?mismatch|requires?.?python|incompatible", "dependency-error"),
    (r"pip.*fail|npm.*fail|cargo.*fail", "dependency-error"),
    (r"flake|flaky|intermittent|timing", "flaky-test"),
    (r"assert|assertEqual|assertion.?error|traceback|error:|exception", "test-failure"),
    (r"typeerror|valueerror|attributeerror|runtimeerror", "test-failure"),
    (r"failed|failures?|FAILED", "test-failure"),
]
CATEGORIES = ["test-failure", "environment-error", "build-failure", "configuration-error", "dependency-error", "flaky-test", "unknown"]
# Classes of environment failures, first match wins.
ENVIRONMENTS = [
    ("empty repo", r"not a git repository"),
    ("version mismatch", r"version mismatch|requires python|unsupported version|incompatible version"),
    ("permission denied", r"permission denied|access is denied|\beacces\b|permissionerror"),
    ("tool missing", r"is not recognized as an internal or external command|\bcommand not found\b|\bno module named\b"),
    ("wrong cwd", r"\benoent\b|\[errno 2\]|\bno such file or directory\b|\bfilenotfounderror\b"),
]
# Markers of an answer that is not sure, in order.
CONFIDENCE_MARKERS = [
    r"\b(?:i'm not sure|i am not sure)\b",
    r"\b(?:i don't know|do not know|don't know)\b",
    r"\b(?:uncertain|unclear|ambiguous)\b",
    r"\b(?:no relevant|no matching|not found)\b",
    r"\b(?:cannot determine|can't determine)\b",
    r"\b(?:unable to|not able to)\b",
    r"\b(?:no information|no data|no context)\b",
    r"\b(?:i cannot find|cannot locate)\b",
    r"\b(?:i was unable|was not able)\b",
    r"\b(?:no diagnosis|no answer)\b",
]
UNSURE = "|".join(CONFIDENCE_MARKERS)
# Messages that only continue a session, texts that stand in injected ones, and greetings.
CONTINUATIONS = ["continue", "continue.", "go on", "keep going", "resume", "continue where you left off",
                 "continue if you have next steps, or stop and ask for clarification if you are unsure how to proceed."]
INJECTED = ["SITUATION REPORT", "PROJECT GOAL (authored by", "Your previous response was interrupted"]
GREETINGS = ["hello", "hi", "hey", "helo", "yo", "hiya", "greetings", "sup"]
# What a goal that takes up interrupted work says.
RESUMES = ["previous response was interrupted", "continue where you left off", "continue from where you left off"]
# Words without substance in a goal.
STOPWORDS = ["the", "a", "an", "and", "or", "to", "for", "of", "in", "on", "with", "my", "me", "i", "is", "it", "this", "that", "please"]


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(F.length(c), F.lit(0)) > 0


def collapse(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def fold(text: Column) -> Column:
    """Lower case with sharp s as double s."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def baseline_paths(text: Column) -> Column:
    """Every token with a slash or backslash becomes its last component; quotes end a token."""
    return F.regexp_replace(text, r"""[^\s'"]*[\\/]([^\s'"\\/]*)""", "$1")


def signature_of(test: Column, error: Column) -> Column:
    """Signature of a failure: test and first error line, collapsed, baselined and folded."""
    return F.concat(fold(baseline_paths(collapse(test))), F.lit(SEPARATOR), fold(baseline_paths(collapse(error))))


def canonical_signature(signature: Column) -> Column:
    """Signature of a composed one, split at its first separator; without one, the error part is empty."""
    at = F.instr(signature, SEPARATOR)
    head = F.when(at > 0, F.substring(signature, F.lit(1), at - 1)).otherwise(signature)
    tail = F.when(at > 0, F.substring(signature, at + len(SEPARATOR), F.length(signature))).otherwise(F.lit(""))
    return signature_of(head, tail)


def normal_goal(goal: Column) -> Column:
    """Goal for comparison: lower case, letters, digits and underscores parted by single blanks."""
    return collapse(F.regexp_replace(F.lower(goal), r"[^\p{L}\p{N}_]+", " "))


def curriculum_goal(goal: Column) -> Column:
    """The other goal form: lower case and collapsed, punctuation kept."""
    return collapse(F.lower(goal))


def shorten(text: Column, limit: int = 200) -> Column:
    """At most ``limit`` characters, cut at the last blank with trailing ``,;:`` off and an ellipsis on."""
    cut = F.regexp_replace(F.substring(text, 1, limit), r"(?s)\s?\S*$", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.regexp_replace(cut, r"[,;:]+$", ""), F.lit("…")))


def slug(text: Column, words: int = 5) -> Column:
    """First words of letters and digits joined by underscores; ``skill_`` goes first where no letter does."""
    parts = F.slice(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1)), 1, words)
    joined = F.array_join(parts, "_")
    return F.when(joined.rlike("^[a-z]"), joined).otherwise(F.concat(F.lit("skill_"), joined))


def content_hash(text: Column) -> Column:
    """SHA-256 of the stripped text."""
    return F.sha2(strip(text), 256)


def failure_fingerprint(kind: Column, text: Column) -> Column:
    """``kind:`` and 16 hex digits of the SHA-256 of kind, bar and the stripped lower-case text."""
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat(kind, F.lit("|"), F.lower(strip(text))), 256), 1, 16))


def redact(text: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """Credential-shaped matches replaced by ``[REDACTED]``, pattern after pattern."""
    for _, pattern in patterns or CREDENTIALS:
        text = F.regexp_replace(text, pattern, "[REDACTED]")
    return text


def flags(text: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """Names of the patterns that occur in the text, in order; the match itself is never shown."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in patterns or [*CREDENTIALS, *DESTRUCTIVE])), lambda x: x.isNotNull())


def first_class(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Class of the first rule ``(pattern, class)`` that matches."""
    out = None
    for pattern, name in rules:
        out = F.when(matches(text, pattern), F.lit(name)) if out is None else out.when(matches(text, pattern), F.lit(name))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def subject_text(signature: Column, excerpt: Column) -> Column:
    """What the subject category of a failure is read from."""
    return F.lower(F.concat_ws(" ", F.coalesce(signature, F.lit("")), F.coalesce(excerpt, F.lit(""))))


def subject_of(text: Column) -> Column:
    """Subject category of a failure by its ``subject_text``, which should be a column of its own, as it is looked at many times."""
    return first_class(text, SUBJECTS, "unknown")


def environment_of(text: Column) -> Column:
    """Class of an environment failure, or ``unsure``."""
    return first_class(F.lower(F.coalesce(text, F.lit(""))), [(p, n) for n, p in ENVIRONMENTS], "unsure")


def environment_match(text: Column) -> Column:
    """The text that decided ``environment_of``; null if none did."""
    low = F.coalesce(text, F.lit(""))
    return F.coalesce(*(F.nullif(F.regexp_extract(low, f"(?i)({p})", 1), F.lit("")) for _, p in ENVIRONMENTS))


def unsure_markers(text: Column) -> Column:
    """Distinct markers of low confidence, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({UNSURE})"), F.lit(1))))


def is_continuation(text: Column) -> Column:
    """Whether a message only asks to go on, or was injected."""
    injected = F.reduce(F.array(*(F.contains(text, F.lit(m)) for m in INJECTED)), F.lit(False), lambda a, x: a | x)
    return F.lower(strip(text)).isin(CONTINUATIONS) | injected


def is_greeting(text: Column) -> Column:
    """Empty, nothing but greetings, or at most two words with a greeting."""
    words = F.filter(F.split(normal_goal(F.coalesce(text, F.lit(""))), " "), lambda w: w != "")
    greet = F.filter(words, lambda w: w.isin(GREETINGS))
    return (F.size(words) == F.size(greet)) | ((F.size(words) <= 2) & (F.size(greet) > 0))


def query_terms(text: Column, limit: int = 12, least: int = 3) -> Column:
    """Distinct words of at least ``least`` characters, those of the last line first, the first ``limit``."""
    lines = F.reverse(F.split(F.lower(text), r"\r\n|[\n\r]"))
    words = F.flatten(F.transform(lines, lambda x: F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))))
    return F.slice(F.array_distinct(F.filter(words, lambda w: F.length(w) >= least)), 1, limit)


def snippet(text: Column, words: list[str], around: int = 80) -> Column:
    """Text around the earliest of the words, with ellipses where it is cut; the first characters if none occurs."""
    low = F.lower(text)
    at = F.array_min(F.filter(F.array(*(F.instr(low, w.lower()) for w in words)), lambda k: k > 0))
    begin = F.greatest(F.coalesce(at, F.lit(1)) - around, F.lit(1))
    size = 2 * around
    part = F.substring(text, begin, F.lit(size))
    return F.concat(F.when(begin > 1, "…").otherwise(""), collapse(part), F.when(begin + size <= F.length(text), "…").otherwise(""))


def first_line(text: Column) -> Column:
    """First line that isn't blank; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?:^|[\r\n])[ \t]*(\S[^\r\n]*)", 1), F.lit(""))


def error_line(text: Column) -> Column:
    """First line that starts with FAIL or ERROR, else the last line that isn't blank, without blanks around it."""
    strong = F.nullif(F.regexp_extract(text, r"(?m)^((?:FAIL|ERROR)[^\r\n]*)", 1), F.lit(""))
    last = F.element_at(F.split(F.rtrim(text, F.lit(" \t\r\n\f\v")), r"[\r\n]"), -1)
    return F.coalesce(strong, F.nullif(F.ltrim(last, F.lit(" \t\f\v")), F.lit("")))


def tail(text: Column, limit: int = 4000) -> Column:
    """Last ``limit`` characters, marked where something is missing."""
    return F.when(F.length(text) > limit, F.concat(F.lit("[truncated] "), F.substring(text, -limit, limit))).otherwise(text)


def head_tail(text: Column, head: int = 5, last: int = 10) -> Column:
    """First and last lines of an output with the number of lines left out between."""
    lines = F.split(text, r"\r\n|[\n\r]")
    n = F.size(lines)
    cut = F.concat(
        F.array_join(F.slice(lines, 1, head), "\n"), F.lit("\n... "), (n - head - last).cast("string"), F.lit(" lines omitted ...\n"), F.array_join(F.slice(lines, -last, last), "\n")
    )
    return F.when(n <= head + last, text).otherwise(cut)


def escape_roles(text: Column) -> Column:
    """Lines that start like a chat role are indented by a blank."""
    return F.regexp_replace(text, r"(?mi)^(system|user|assistant|tool):", " $1:")


def parse_stamp(stamp: Column) -> Column:
    """Timestamp of an ISO-8601 string with Z, an offset, or none (UTC, whatever the session's zone); null if it isn't one."""
    return F.try_to_timestamp(F.when(stamp.rlike(r"(?:[Zz]|[+-]\d\d:?\d\d)$"), stamp).otherwise(F.concat(stamp, F.lit("Z"))))


def epoch(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp."""
    return F.unix_seconds(ts)


def utc_stamp(ts: Column) -> Column:
    """ISO-8601 with seconds and Z, whatever the session's zone (a clock without zone, so no hour of a change of clocks is lost)."""
    clock = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + F.make_dt_interval(secs=F.unix_seconds(ts).cast("decimal(18,6)"))
    return F.concat(F.replace(clock.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


def version_tuple(text: Column) -> Column:
    """Numbers of the first dotted number in a text; null if it has none."""
    found = F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)+|\d+)", 1), F.lit(""))
    return F.transform(F.split(found, r"\."), lambda x: x.cast("int"))


def byte_cap(text: Column, limit: int = 65536) -> tuple[Column, Column]:
    """(text within ``limit`` bytes of UTF-8, whether it was cut); never inside a character."""
    whole = F.octet_length(text) <= limit
    raw = F.substring(F.to_binary(text, F.lit("utf-8")), 1, limit)
    kept = F.regexp_replace(F.make_valid_utf8(raw.cast("string")), "�+$", "")
    return F.when(whole, text).otherwise(kept), F.coalesce(~whole, F.lit(False))
