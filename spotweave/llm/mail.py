"""The texts of a stored mail message as its reader sees them."""

from __future__ import annotations

import email
import email.header
import html
import re
import unicodedata

BLOCK = r"address|article|blockquote|br|caption|dd|div|dl|dt|fieldset|footer|form|h[1-6]|header|hr|img|input|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul"
BREAKING = re.compile(rf"</?(?:{BLOCK})\b[^<>]*>", re.I)
TAG = re.compile(r"<[a-zA-Z/!?][^<>]*>")
STYLE = re.compile(r"<(style|script)\b[^>]*>.*?(?:</\1\s*>|$)", re.I | re.S)
COMMENT = re.compile(r"<!--.*?(?:-->|$)", re.S)
#: Characters that a reader does not see.
HIDDEN = re.compile("[​-‍﻿­]")
KNOWN = r"(?:From|To|Cc|Bcc|Subject|Date|Message-ID|In-Reply-To|References|MIME-Version|Content-[A-Za-z-]+|Received|User-Agent|Reply-To|Sender|Return-Path|Precedence|Mailing-List|List-[A-Za-z-]+|X-[A-Za-z-]+)"
KNOWN_LINE = re.compile(rf"^{KNOWN}:", re.I | re.M)
#: Header fields from the start of a text on, folded lines and the mark of a mailbox file included.
BLOCK_OF_HEADERS = re.compile(r"\s*(?:From [^\r\n]*(?:\r\n?|\n))?(?:[!-9;-~]+:[^\r\n]*(?:\r\n?|\n|$)(?:[ \t][^\r\n]*(?:\r\n?|\n|$))*)*")
FLAT = re.compile(rf" (?={KNOWN}: )")
FLAT_BODY = re.compile(r"(\nContent-Transfer-Encoding: *[A-Za-z0-9-]+) ", re.I)
WORD = re.compile(r"[^\W_]+")
STRETCH = re.compile(r"\S+")


def unmarked(text: str) -> str:
    """An HTML text without style sheets, scripts, comments and tags, entities resolved."""
    text = TAG.sub("", BREAKING.sub(" ", COMMENT.sub(" ", STYLE.sub(" ", text))))
    return html.unescape(text)


def words(text: str) -> list[str]:
    """Unbroken runs of letters and digits in Unicode form NFKC, lower case, hidden characters removed."""
    if not text.isascii():
        text = HIDDEN.sub("", unicodedata.normalize("NFKC", HIDDEN.sub("", text)))
    return WORD.findall(text.lower())


def word_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) in ``text`` of each of its ``words``.

    Text between white space is normalised on its own. Where the normal form of such a stretch is not that of its characters one by one (composed
    letters), each of its words stands for the whole stretch.
    """
    if text.isascii():
        return [m.span() for m in WORD.finditer(text.lower())]
    out, low = [], lambda t: t.lower().replace("ς", "σ")
    for m in STRETCH.finditer(text):
        said, at = m[0], m.start()
        if said.isascii():
            out += [(at + w.start(), at + w.end()) for w in WORD.finditer(said.lower())]
            continue
        each = ["" if HIDDEN.match(c) else low(HIDDEN.sub("", unicodedata.normalize("NFKC", c))) for c in said]
        whole = low(HIDDEN.sub("", unicodedata.normalize("NFKC", HIDDEN.sub("", said))))
        if "".join(each) == whole:
            owner = [k for k, c in enumerate(each) for _ in c]
            out += [(at + owner[w.start()], at + owner[w.end() - 1] + 1) for w in WORD.finditer(whole)]
        else:
            out += [m.span()] * len(WORD.findall(whole))
    return out


def _charset(raw: bytes, said: str | None) -> str:
    for name in (said or "utf-8", "utf-8", "cp1252"):
        try:
            return raw.decode(name)
        except (LookupError, UnicodeDecodeError, ValueError):
            continue
    return raw.decode("latin-1")


def _subject(value) -> str:
    out = []
    try:
        for raw, charset in email.header.decode_header(str(value)):
            out.append(_charset(raw, charset) if isinstance(raw, bytes) else raw)
    except (ValueError, email.errors.HeaderParseError):
        return str(value)
    return "".join(out)


def _inflate(text: str) -> str:
    """A message whose line ends were lost: line ends before known headers and round part marks again."""
    marks = re.findall(r'boundary="?([^"\s;]+)"?', text)
    text = FLAT.sub("\n", text)
    for mark in marks:
        text = text.replace(f"--{mark}--", f"\n--{mark}--\n").replace(f"--{mark} ", f"\n--{mark}\n").replace(f"--{mark}\n", f"\n--{mark}\n")
    return FLAT_BODY.sub(r"\1\n\n", text)


def _leaf(part) -> str:
    if part.is_multipart():
        return ""
    encoded = (part.get("Content-Transfer-Encoding") or "").strip().lower()
    try:
        if encoded in ("base64", "quoted-printable", "x-uuencode", "uuencode", "uue", "x-uue"):
            text = _charset(part.get_payload(decode=True) or b"", part.get_content_charset())
        else:
            text = part.get_payload()
            if not isinstance(text, str):
                return ""
    except (ValueError, LookupError, AssertionError):
        return ""
    kind = part.get_content_type()
    return unmarked(text) if kind in ("text/html", "application/xhtml+xml") or (kind.startswith("multipart/") and "<html" in text.lower()) else text


def parts(text: str) -> list[str]:
    """Subject and text parts: bodies, attached texts and attached messages, each as read.

    Transfer and header encodings and charsets are undone; an unknown or wrong charset falls back to UTF-8, then Windows-1252.
    A text is a message if the block of header fields at its start, however long, has a known one; any other text is one body. Attachments that
    are no text are left out. A message that has lost its line ends is read with line ends put back before headers and part marks, and once more as it stands.
    A message that cannot be taken apart, such as one of very many messages within messages, is one body as it stands.
    """
    one_line = "\n" not in text and "\r" not in text
    if not (FLAT.search(" " + text) if one_line else KNOWN_LINE.search(BLOCK_OF_HEADERS.match(text)[0])):
        return [unmarked(text) if "<html" in text.lower() else text]
    out = []
    if one_line:
        out.append(unmarked(text) if "<" in text else text)
        text = _inflate(text)
    try:
        message = email.message_from_string(text)
        found = list(message.walk())
    except (ValueError, TypeError, IndexError, RecursionError):
        return [*out, text]
    for part in found:
        if part is message or part.get_content_type() == "message/rfc822" or part.get("Subject"):
            if part.get("Subject") is not None:
                out.append(_subject(part["Subject"]))
        if part.get_content_maintype() in ("text", "multipart", "message"):
            if body := _leaf(part):
                out.append(body)
    return out
