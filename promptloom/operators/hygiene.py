"""Hazards in a text: secrets, personal data and injection phrases. They are shown, never rewritten."""

from __future__ import annotations

import re

from ..options import Hygiene
from .finding import Finding
from .protect import EMAIL, code_spans, links
from .spans import SPACE, Taken

_S = re.escape(SPACE)

# Shapes and messages must be these for results to match. In order of priority.
SECRETS = (
    (r"(?a)\bsk-proj-[A-Za-z0-9_-]{16,}\b", "Possible OpenAI API key"),
    (r"(?a)\bsk-[A-Za-z0-9]{20,}\b", "Possible OpenAI API key"),
    (r"(?a)\bgithub_pat_[A-Za-z0-9_]{20,}\b", "Possible GitHub token"),
    (r"(?a)\bghp_[A-Za-z0-9]{20,}\b", "Possible GitHub token"),
    (r"(?a)\bgho_[A-Za-z0-9]{20,}\b", "Possible GitHub token"),
    (r"(?a)\bAKIA[0-9A-Z]{16}\b", "Possible AWS access key"),
    (r"(?a)\bxox[baprs]-[A-Za-z0-9-]{10,}\b", "Possible Slack token"),
    (r"(?a)\bAIza[0-9A-Za-z_-]{35}\b", "Possible Google API key"),
    (r"(?a)\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "Possible JWT"),
    (r"(?s)-----BEGIN (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY-----.*?-----END (?:RSA |OPENSSH |EC |DSA )?PRIVATE KEY-----", "Possible private key block"),
    (rf"(?ai)Authorization[{_S}]*:[{_S}]*Bearer[{_S}]+[^{_S}]+", "Possible bearer token"),
)
PHONE = rf"(?a)\b(?:\+1[-.{_S}]?)?(?:\([0-9]{{3}}\)|[0-9]{{3}})[-.{_S}][0-9]{{3}}[-.{_S}][0-9]{{4}}\b"
SSN = r"(?a)\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
CARD = r"(?a)\b(?:[0-9][ \t-]*?){13,19}\b"
INJECTIONS = (
    (r"(?ai)ignore (?:all )?previous instructions", "Possible prompt injection"),
    (r"(?ai)ignore (?:all )?(?:prior|above) (?:instructions|prompts)", "Possible prompt injection"),
    (r"(?ai)you are now", "Possible jailbreak phrase"),
    (r"(?ai)you are DAN", "Possible jailbreak phrase"),
    (r"(?a)\bDAN\b", "Possible jailbreak phrase"),
    (r"(?ai)reveal (?:your )?(?:system )?prompt", "Possible prompt injection"),
    (r"(?ai)disregard (?:your )?(?:rules|guidelines|instructions)", "Possible prompt injection"),
    (r"(?ai)\bjailbreak\b", "Possible jailbreak phrase"),
)
INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff"

#: A text without any of these has no hazard; it spares most texts the many patterns.
_HINT = re.compile(r"(?ai)@|[0-9]{3}|[0-9][ \t-]+[0-9]|sk-|gh[po]_|github_pat_|AKIA|xox|AIza|eyJ|-----BEGIN|bearer|ignore |you are|DAN|reveal |disregard |jailbreak")


def luhn(raw: str) -> bool:
    digits = [int(c) for c in reversed(raw) if c.isdigit()]
    doubled = sum(d * 2 - 9 * (d > 4) for d in digits[1::2])
    return 13 <= len(digits) <= 19 and (sum(digits[::2]) + doubled) % 10 == 0


def visible(text: str) -> tuple[str, list[int] | None]:
    """The text without invisible characters, and the place of each that stays (None: all stay)."""
    if not any(c in text for c in INVISIBLE):
        return text, None
    places = [i for i, c in enumerate(text) if c not in INVISIBLE]
    return "".join(text[i] for i in places), places


def find_hygiene(text: str | None, wanted: Hygiene | None = Hygiene()) -> list[Finding]:
    """Hazards outside code, none over another; earlier patterns win."""
    if not text or wanted is None or not wanted.any():
        return []
    clear, places = visible(text)
    if not _HINT.search(clear) and not _HINT.search(text):
        return []
    code = Taken(code_spans(text))
    claimed, out = Taken(), []

    def note(start: int, end: int, kind: str, message: str, skip: Taken = code) -> None:
        if not skip.meets(start, end) and not claimed.meets(start, end):
            claimed.add(start, end)
            out.append(Finding(start, end, text[start:end], text[start:end], kind, "warn" if kind == "pii" else "critical", message))

    if wanted.secrets:
        for pattern, message in SECRETS:
            for m in re.finditer(pattern, text):
                note(*m.span(), "secret", message)
    if wanted.pii:
        addresses = Taken([*code.spans, *links(text)])
        for pattern, message, skip in ((EMAIL, "Possible email address", addresses), (PHONE, "Possible phone number", code), (SSN, "Possible Social Security number", code), (CARD, "Possible credit card number", code)):
            for m in re.finditer(pattern, text):
                if pattern is not CARD or luhn(m[0]):
                    note(*m.span(), "pii", message, skip)
    if wanted.injection:
        for pattern, message in INJECTIONS:
            for m in re.finditer(pattern, clear):
                start, end = m.span() if places is None else (places[m.start()], places[m.end() - 1] + 1)
                note(start, end, "injection", message)
    return sorted(out, key=lambda f: f.start)
