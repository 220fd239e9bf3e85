"""Credentials and injected instructions in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The credential patterns with their labels, in the order in which they are replaced.
CREDENTIALS = (
    (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "PEM_PRIVATE_KEY"),
    (r"(?i)\b(?:sk|rk)[-_][a-zA-Z0-9_-]{20,}", "SECRET_KEY"),
    (r"ghp_[a-zA-Z0-9]{36,}", "GITHUB_PAT"),
    (r"gho_[a-zA-Z0-9]{36,}", "GITHUB_OAUTH"),
    (r"ghs_[a-zA-Z0-9]{36,}", "GITHUB_APP"),
    (r"ghr_[a-zA-Z0-9]{36,}", "GITHUB_REFRESH"),
    (r"AKIA[A-Z0-9]{16}", "AWS_ACCESS_KEY"),
    (r"""(?i)(?:password|passwd|secret|api_key|apikey|access_token|auth_token)\s*[=:]\s*["'][^\s"']{8,}["']""", "CREDENTIAL_ASSIGNMENT"),
    (r"eyJ[a-zA-Z0-9_-]{20,}\.eyJ[a-zA-Z0-9_-]{20,}\.[a-zA-Z0-9_-]{20,}", "JWT_TOKEN"),
    (r"xox[bpoas]-[a-zA-Z0-9-]{10,}", "SLACK_TOKEN"),
    (r"""(?i)authorization["']?\s*[=:]\s*["']?Bearer\s+[A-Za-z0-9\-_.=]{8,}""", "BEARER_AUTH_HEADER"),
    (r"""[a-zA-Z][a-zA-Z0-9+.\-]{1,15}://[^\s'"/:@]{0,64}:[^\s'"/@]{3,}@""", "URL_EMBEDDED_CREDENTIAL"),
    (r"""(?m)^\s*(?:export\s+)?(?:[A-Z][A-Z0-9]*_)?(?:PASSWORD|PASSWD|SECRET|TOKEN|API_KEY|APIKEY|ACCESS_KEY|PRIVATE_KEY|CREDENTIAL)\s*[=:]\s*[^\s#'"(){}\[\];,]{8,}""", "ENV_STYLE_ASSIGNMENT"),
)
#: Patterns of injected instructions with their labels.
INJECTIONS = (
    (r"(?i)ignore\s+(all\s+|any\s+)?(previous|prior|above)\s+instructions", "IGNORE_PRIOR_INSTRUCTIONS"),
    (r"(?i)disregard\s+(all\s+|any\s+)?(previous|prior|above)", "DISREGARD_PRIOR"),
    (r"(?i)new\s+instructions\s*:", "NEW_INSTRUCTIONS"),
    (r"(?im)^\s*(system|assistant)\s*:", "FAKE_ROLE_MARKER"),
    (r"(?i)you are now (a|an|in)\b", "ROLE_OVERRIDE"),
    (r"(?i)reveal (your|the) (system prompt|instructions)", "PROMPT_EXFIL"),
    (r"(?i)do not (tell|inform|notify) the user", "HIDE_FROM_USER"),
    (r"(?i)without (telling|informing|notifying) the user", "HIDE_FROM_USER"),
    (r"<\|(im_start|im_end|system|assistant|user)\|>", "CHATML_ROLE_MARKER"),
    (r"(?i)\[/?(INST|SYS)\]", "INST_BRACKET_MARKER"),
    (r"</?(tool_result|function_results|tool_use)>", "FAKE_TOOL_BOUNDARY"),
    (r"(?im)^#{1,4}\s*system\s*(prompt|instructions?)\b", "MARKDOWN_ROLE_HEADER"),
    (r"(?i)\b(DAN mode|developer mode|jailbroken?|do anything now)\b", "JAILBREAK_PERSONA"),
    (r"(?i)\bact as (an?\s+)?(unrestricted|unfiltered|uncensored)\b", "UNRESTRICTED_PERSONA"),
    (r"(?i)(print|output|repeat|show)\s+(your|the)\s+(system prompt|initial prompt)", "PROMPT_EXFIL"),
    (r"(?i)repeat (everything|all( of)? the text) (above|before this)", "REPEAT_EVERYTHING_ABOVE"),
    (r"(?i)(send|post|upload)\s+(the|your|these)\s+(api[- ]?keys?|credentials|secrets|tokens?)\s+to\b", "EXFIL_SECRETS_REQUEST"),
    (r"(?i)\bdecode\s+(and\s+)?(run|execute|follow|obey)\b", "DECODE_AND_EXECUTE"),
    ("[​‌‍﻿⁠]", "ZERO_WIDTH_UNICODE"),
    ("(?iu)bỏ qua\\s+(mọi\\s+|các\\s+)?(hướng dận|chỉ thị)\\s+(trước|phía trên)", "IGNORE_PRIOR_INSTRUCTIONS_VI"),
    ("(?iu)bạn (giờ|bây giờ)̀ là", "ROLE_OVERRIDE_VI"),
)
#: What a lower-cased text must hold, one of them at least, for the pattern of the same place to match: plain search is much faster than these patterns.
NEEDED = (
    ("ignore",), ("disregard",), ("instructions",), ("system", "assistant"), ("you are now",), ("reveal",), ("the user",), ("the user",), ("<|",), ("inst]", "sys]"), ("tool_result", "function_results", "tool_use"),
    ("system",), ("dan mode", "developer mode", "jailbroke", "do anything now"), ("act as",), ("prompt",), ("repeat",), ("send", "post", "upload"), ("decode",), (), ("qua",), ("bạn",),
)
#: Shortest run that may hide text, and how deep runs in decoded text are followed.
RUN, DEPTH = 24, 2


def redact(text: Column) -> Column:
    """Each credential replaced by its label. Which patterns apply is decided on the original text; they are replaced in order."""
    out = text
    for pattern, label in CREDENTIALS:
        # a pattern that can't match stands in where the original text has no match: ``out`` is named once, so the expression stays linear
        out = F.regexp_replace(out, F.when(F.rlike(text, F.lit(pattern)), pattern).otherwise("(?!)"), F.lit(f"[REDACTED:{label}]"))
    return out


def has_credentials(text: Column) -> Column:
    """X02."""
    out = F.lit(False)
    for pattern, _ in CREDENTIALS:
        out = out | F.rlike(text, F.lit(pattern))
    return F.coalesce(out, F.lit(False))


def injections(text: Column) -> Column:
    """The labels of the patterns that match, in their order; a label may repeat."""

    def found(low: Column) -> Column:
        def may(needed: tuple[str, ...]) -> Column:
            out = F.lit(not needed)
            for word in needed:
                out = out | F.contains(low, F.lit(word))
            return out

        return F.array_compact(F.array(*[F.when(may(needed) & F.rlike(text, F.lit(p)), label) for (p, label), needed in zip(INJECTIONS, NEEDED, strict=True)]))

    # the lower-cased text is bound as a lambda's variable, so that it is made once for each row
    return F.transform(F.array(F.lower(text)), found)[0]


def decoded(text: Column) -> Column:
    """Readable texts behind base64 (both alphabets) and hexadecimal runs of the text."""
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9+/_-]{%d,}={0,2})" % RUN), 1)

    def readable(binary: Column) -> Column:
        s = F.try_validate_utf8(binary.cast("string"))
        plain = F.length(s) - F.length(F.regexp_replace(s, r"[\x20-\x7E\s]", ""))
        return F.when((F.length(s) > 0) & (plain > 0.85 * F.length(s)), s)

    def each(x: Column) -> Column:
        bare = F.regexp_replace(x, "=+$", "")
        standard = F.translate(bare, "-_", "+/")
        padded = F.concat(standard, F.repeat(F.lit("="), F.pmod(-F.length(bare), F.lit(4)).cast("int")))
        return F.array(readable(F.try_to_binary(padded, F.lit("base64"))), readable(F.when(F.rlike(x, F.lit("^(?:[0-9A-Fa-f]{2})+$")), F.unhex(x))))

    return F.array_compact(F.flatten(F.transform(runs, each)))


def hidden_injections(text: Column, depth: int = DEPTH) -> Column:
    """Labels found in decoded runs, and in runs of these down to ``depth``. All runs are tried; there is no budget that could end the scan early."""
    level, found = decoded(text), F.array().cast("array<string>")
    for k in range(depth):
        found = F.concat(found, F.flatten(F.transform(level, injections)))
        if k + 1 < depth:
            level = F.flatten(F.transform(level, decoded))
    return F.array_sort(F.array_distinct(found))


def wrap_untrusted(text: Column, source: Column) -> Column:
    """Text between tags that name its source; look-alikes of the tags inside lose their brackets."""
    tag = "untrusted-external-content"
    clean = F.regexp_replace(text, rf"(?i)<(/?{tag}\b[^>]*)>", "‹$1›")
    return F.concat(F.lit(f'<{tag} source="'), F.replace(source, F.lit('"'), F.lit("'")), F.lit('">\n'), clean, F.lit(f"\n</{tag}>"))


#: Characters of a text that the scanning tool reads (a fixed value of the tool).
SCAN_CHARS = 500_000


def scan_text(text: Column, source: Column) -> Column:
    """n_chars, whether credentials were found, injection labels, hidden labels and the wrapped text of the first ``SCAN_CHARS`` characters."""
    whole = F.coalesce(text, F.lit(""))
    read = F.left(whole, F.lit(SCAN_CHARS))
    return F.struct(F.length(whole).alias("n_chars"), has_credentials(read).alias("has_credentials"), injections(read).alias("injections"), hidden_injections(read).alias("hidden"), wrap_untrusted(read, source).alias("wrapped"))
