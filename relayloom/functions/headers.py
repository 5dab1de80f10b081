"""Headers as JSON text: a flat object of strings.

Encoding is a built-in. Decoding is strict where the built-in parser is lenient, and lenient
in two places where it is not, so texts go through an Arrow UDF, which gets nulls for null and plainly well-formed
texts (`decode_headers`).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

DECODED = T.StructType([T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("error", T.StringType())])
_ESCAPES = {'"': '"', "\\": "\\", "/": "/", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}
_PLAIN = re.compile(r'[^"\\]*')
_BLANK = re.compile(r"[ \t\n\r]*")


def encode_headers(headers: Column) -> Column:
    """JSON text; null for null and for an empty map."""
    return F.when(F.size(headers) > 0, F.to_json(headers, {"ignoreNullFields": "false"}))


@dataclass
class _Reader:
    text: str
    at: int = 0

    def skip(self) -> str:
        self.at = _BLANK.match(self.text, self.at).end()
        return self.text[self.at : self.at + 1]

    def expect(self, c: str) -> None:
        if self.skip() != c:
            raise ValueError(f"expected {c} at {self.at}")
        self.at += 1

    def unit(self) -> int:
        digits = self.text[self.at : self.at + 4]
        if not re.fullmatch("[0-9a-fA-F]{4}", digits):
            raise ValueError(f"bad escape at {self.at}")
        self.at += 4
        return int(digits, 16)

    def string(self) -> str:
        self.expect('"')
        out = []
        while True:
            plain = _PLAIN.match(self.text, self.at)
            out.append(plain[0])
            self.at = plain.end()
            mark = self.text[self.at : self.at + 1]
            self.at += 1
            if mark == '"':
                return "".join(out)
            if not mark:
                raise ValueError("text ends in a string")
            kind = self.text[self.at : self.at + 1]
            self.at += 1
            if kind == "u":
                code = self.unit()
                if 0xDC00 <= code <= 0xDFFF:
                    raise ValueError("low surrogate alone")
                if 0xD800 <= code <= 0xDBFF:
                    if self.text[self.at : self.at + 2] != "\\u":
                        raise ValueError("high surrogate alone")
                    self.at += 2
                    low = self.unit()
                    if not 0xDC00 <= low <= 0xDFFF:
                        raise ValueError("high surrogate alone")
                    code = 0x10000 + ((code - 0xD800) << 10) + (low - 0xDC00)
                out.append(chr(code))
            elif kind in _ESCAPES:
                out.append(_ESCAPES[kind])
            else:
                raise ValueError(f"unknown escape {kind}")


def parse_headers(text: str | None) -> dict[str, str]:
    """A flat object; null, blank text and the word null give none. A null value drops its key, the
    last of equal keys counts, a trailing comma and text after the object pass; all else is an error."""
    if text is None or text.strip() in ("", "null"):
        return {}
    reader, out = _Reader(text.strip()), {}
    reader.expect("{")
    while reader.skip() != "}":
        key = reader.string()
        reader.expect(":")
        if reader.skip() == '"':
            out[key] = reader.string()
        elif reader.text.startswith("null", reader.at):
            reader.at += 4
        else:
            raise ValueError("values are strings")
        if reader.skip() == ",":
            reader.at += 1
        elif reader.skip() != "}":
            raise ValueError(f"expected , or }} at {reader.at}")
    return out


@F.pandas_udf(DECODED)
def _decode(texts: pd.Series) -> pd.DataFrame:
    maps, errors = [], []
    for text in texts:
        try:
            maps.append(parse_headers(text))
            errors.append(None)
        except ValueError as e:
            maps.append(None)
            errors.append(str(e))
    return pd.DataFrame({"headers": maps, "error": errors})


#: Objects of strings without escapes: here the built-in parser gives the same.
_SIMPLE = r'^\{("[^"\\\x00-\x1f]*":"[^"\\\x00-\x1f]*"(,"[^"\\\x00-\x1f]*":"[^"\\\x00-\x1f]*")*)?\}$'


def decode_strict(text: Column) -> Column:
    """struct(headers, error) by the strict parser alone."""
    return _decode(text)


def needs_parser(text: Column) -> Column:
    return text.isNotNull() & ~text.rlike(_SIMPLE)


def decode_headers(text: Column) -> Column:
    """struct(headers, error), by the built-in parser where that gives the same."""
    hard = needs_parser(text)
    strict = decode_strict(F.when(hard, text))
    easy = F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.struct(F.when(hard, strict["headers"]).otherwise(easy).alias("headers"), F.when(hard, strict["error"]).alias("error"))


@dataclass(frozen=True)
class Codec:
    """How headers become text and come back; another pair of column functions may take the place of this one."""

    encode: Callable[[Column], Column] = encode_headers
    #: To a struct of headers (a map) and error.
    decode: Callable[[Column], Column] = decode_headers


CODEC = Codec()
