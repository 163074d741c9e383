"""The readable texts of a raw message: its subject and its text parts, with transfer encodings and markup undone.

Messages may be cut off or garbled, so nothing here raises: what cannot be decoded is kept as it stands.
"""

from __future__ import annotations

import binascii
import codecs
import html
import re

_FIELD = re.compile(r"[!-9;-~]+[ \t]*:")
_FOLD = re.compile(r"\n[ \t]+")
_PARAM = re.compile(r';\s*([\w*-]+)\s*=\s*(?:"((?:[^"\\]|\\.)*)"|([^\s;]+))')
_WORD = re.compile(r"=\?([^?\s]+)\?([bBqQ])\?([^?\s]*)\?=")
_BETWEEN = re.compile(r"(\?=)\s+(?==\?[^?\s]+\?[bBqQ]\?)")
_NOT64 = re.compile(r"[^A-Za-z0-9+/]+")
_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(style|script)\b.*?(?:</\1\s*>|\Z)", re.S | re.I)
#: Tags that do not end a word.
_INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|del|em|font|i|ins|kbd|mark|o:p|q|s|samp|small|span|strike|strong|sub|sup|tt|u|var|wbr)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[/!?]?[a-zA-Z][^<>]*>|<!\w[^<>]*>")
_QUOTE = re.compile(r"^[ \t]*(?:[A-Z]{0,3}[>|][ \t]?)+", re.M)
DEPTH = 20


def _charset(data: bytes, name: str) -> str:
    try:
        codec = codecs.lookup(name or "utf-8").name
        return data.decode(codec, "replace")
    except (LookupError, ValueError, UnicodeError):
        return data.decode("utf-8", "replace")


def _base64(text: str) -> bytes:
    body = _NOT64.sub("", text.partition("=")[0] if text.rstrip().endswith("=") and "=" in text.rstrip()[-2:] else text)
    body = body[: len(body) - 1] if len(body) % 4 == 1 else body
    return binascii.a2b_base64(body + "=" * (-len(body) % 4))


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _encoded_word(m: re.Match) -> str:
    name, how, text = m.groups()
    name = name.partition("*")[0]
    try:
        data = _base64(text) if how in "bB" else binascii.a2b_qp(_bytes(text), header=True)
    except (binascii.Error, ValueError):
        return text
    return _charset(data, name)


def header_text(value: str) -> str:
    """A header's value, unfolded, with its encoded words decoded."""
    return _WORD.sub(_encoded_word, _BETWEEN.sub(r"\1", value)) if "=?" in value else value


def _head(text: str) -> tuple[dict[str, str], str]:
    """Headers (first of each name, lower case) and body; a text that doesn't begin with a header field is all body."""
    if text.startswith(("From ", ">From ")):
        text = text.partition("\n")[2]
    if text.startswith("\n"):
        return {}, text[1:]
    if not _FIELD.match(text):
        return {}, text
    end = text.find("\n\n")
    head, body = (text, "") if end < 0 else (text[:end], text[end + 2 :])
    lines = _FOLD.sub(" ", head).split("\n")
    fields: dict[str, str] = {}
    for k, line in enumerate(lines):
        name, colon, value = line.partition(":")
        if not colon or not _FIELD.match(line):
            if k and line.strip():  # headers that run into the body without a blank line
                return fields, "\n".join(lines[k:]) + "\n\n" + body
            continue
        fields.setdefault(name.strip().lower(), value.strip())
    return fields, body


def _params(value: str) -> dict[str, str]:
    return {n.lower(): (quoted or plain) for n, quoted, plain in _PARAM.findall(value)}


def plain_text(markup: str) -> str:
    """HTML as text: markup dropped, character references resolved."""
    if "<!--" in markup or "style" in markup or "script" in markup or "STYLE" in markup or "SCRIPT" in markup:
        markup = _HIDDEN.sub(" ", markup)
    return html.unescape(_TAG.sub(" ", _INLINE.sub("", markup)))


def without_quote_marks(text: str) -> str:
    """Quote marks at the start of lines, also those with a writer's initials, become spaces."""
    return _QUOTE.sub(" ", text) if ">" in text or "|" in text else text


def _decoded(body: str, how: str, charset: str) -> str:
    try:
        if how == "base64":
            return _charset(_base64(body), charset)
        if how == "quoted-printable" and "=" in body:
            return _charset(binascii.a2b_qp(_bytes(body)), "utf-8" if any(c > "\x7f" for c in body) else charset)
    except (binascii.Error, ValueError):
        pass
    return body


def _split(body: str, boundary: str) -> list[str]:
    """The parts between boundary lines, without the preamble and what follows the closing line."""
    parts, mark = [], f"--{boundary}"
    at = 0 if body.startswith(mark) else body.find("\n" + mark)
    while at >= 0:
        line = body.find("\n", at + 1 if body[at : at + 1] == "\n" else at)
        if line < 0:
            break
        closing = body[at:line].lstrip("\n")[len(mark) :].rstrip() == "--"
        if closing:
            break
        after = body.find("\n" + mark, line)
        parts.append(body[line + 1 : after] if after >= 0 else body[line + 1 :])
        at = after
    return parts


def _walk(text: str, out: list[str], depth: int, root: bool) -> None:
    fields, body = _head(text)
    if root and "subject" in fields:
        out.append(header_text(fields["subject"]))
    value = fields.get("content-type", "text/plain")
    kind = value.partition(";")[0].strip().lower()
    how = fields.get("content-transfer-encoding", "").strip().lower()
    if kind.startswith("multipart/") and depth < DEPTH:
        boundary = _params(value).get("boundary", "")
        parts = _split(body, boundary) if boundary else []
        if parts:
            for part in parts:
                _walk(part, out, depth + 1, False)
            return
        kind = "text/plain"
    if kind == "message/rfc822" and depth < DEPTH:
        _walk(_decoded(body, how, "utf-8"), out, depth + 1, True)
    elif kind.startswith("text/") or "/" not in kind:
        readable = _decoded(body, how, _params(value).get("charset", "")).replace("\r\n", "\n")
        if kind == "text/html":
            readable = plain_text(readable)
        out.append(without_quote_marks(readable))


def readable_texts(message: str | None) -> list[str]:
    """The subject, if any, and each text part (plain, HTML or attached) of a message; [] of a null or empty one."""
    out: list[str] = []
    if message:
        _walk(message.replace("\r\n", "\n").replace("\r", "\n"), out, 0, True)
    return out
