"""Items, module declarations and includes of Rust source text.

A tokenizer that knows strings, characters, lifetimes and comments, and a walk over
balanced brackets. Whatever it cannot read is an error, and an error widens."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""
    (?P<space>\s+)
  | (?P<line>//[^\n]*)
  | (?P<block>/\*)
  | (?P<raw>(?:br|cr|r)(?P<hash>\#*)")
  | (?P<text>(?:b|c)?"(?:[^"\\]|\\.)*")
  | (?P<char>b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))')
  | (?P<life>'[A-Za-z_]\w*)
  | (?P<word>(?:r\#)?[^\W\d]\w*)
  | (?P<number>\d[\w.]*?(?=\.\.|[^\w.]|$))
  | (?P<sign>::|->|=>|[^\w\s])
    """,
    re.VERBOSE | re.DOTALL,
)
# What a word at the head of an item makes of it.
HEADS = {
    "const": "Const", "enum": "Enum", "fn": "Fn", "mod": "Mod", "static": "Static", "struct": "Struct", "trait": "Trait",
    "type": "TypeAlias", "union": "Union", "use": "Use", "impl": "Impl",
}
MODIFIERS = {"async", "default", "extern", "safe", "unsafe", "const"}
INCLUDES = {"include": "include", "include_str": "include_str", "include_bytes": "include_bytes"}
CLOSES = {"(": ")", "[": "]", "{": "}"}


class RustSyntaxError(ValueError):
    pass


@dataclass
class Token:
    kind: str
    text: str
    line: int
    column: int
    end_line: int
    end_column: int


@dataclass
class Parsed:
    items: list[dict] = field(default_factory=list)
    modules: list[dict] = field(default_factory=list)
    sources: list[tuple[str, str]] = field(default_factory=list)


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, line, start = 0, 1, 0

    def push(kind: str, end: int) -> None:
        nonlocal at, line, start
        piece = text[at:end]
        first, column = line, at - start
        breaks = piece.count("\n")
        if breaks:
            line += breaks
            start = at + piece.rfind("\n") + 1
        if kind:
            out.append(Token(kind, piece, first, column, line, end - start))
        at = end

    if text.startswith("#!") and not text.startswith("#!["):
        push("", text.find("\n") % (len(text) + 1))
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise RustSyntaxError(f"unreadable text at line {line}")
        kind = m.lastgroup if m.lastgroup != "hash" else "raw"
        if m["raw"]:
            end = text.find('"' + m["hash"], m.end())
            if end < 0:
                raise RustSyntaxError(f"unclosed raw string at line {line}")
            push("text", end + 1 + len(m["hash"]))
        elif kind == "block":
            depth, end = 1, m.end()
            while depth:
                inner = re.compile(r"/\*|\*/").search(text, end)
                if not inner:
                    raise RustSyntaxError(f"unclosed comment at line {line}")
                depth += 1 if inner[0] == "/*" else -1
                end = inner.end()
            push("", end)
        elif kind == "sign" and m[0] == '"':
            raise RustSyntaxError(f"unclosed string at line {line}")
        else:
            push("" if kind in ("space", "line") else kind, m.end())
    return out


def pairs(found: list[Token]) -> dict[int, int]:
    """Index of the closing bracket for each opening one."""
    held: list[int] = []
    match: dict[int, int] = {}
    for i, t in enumerate(found):
        if t.kind == "sign" and t.text in CLOSES:
            held.append(i)
        elif t.kind == "sign" and t.text in ")]}":
            if not held or CLOSES[found[held[-1]].text] != t.text:
                raise RustSyntaxError(f"unbalanced {t.text} at line {t.line}")
            match[held.pop()] = i
    if held:
        raise RustSyntaxError(f"unclosed bracket at line {found[held[-1]].line}")
    return match


def literal(token: Token) -> str | None:
    """Value of a string literal without escapes that matter for paths."""
    m = re.fullmatch(r'r(#*)"(.*)"\1', token.text, re.DOTALL) or re.fullmatch(r'()"((?:[^"\\]|\\["\\])*)"', token.text, re.DOTALL)
    return re.sub(r'\\(["\\])', r"\1", m[2]) if m else None


class Walker:
    def __init__(self, text: str, path: str):
        self.t = tokens(text)
        self.match = pairs(self.t)
        self.path = path
        self.out = Parsed()

    def is_sign(self, i: int, text: str, end: int) -> bool:
        return i < end and self.t[i].kind == "sign" and self.t[i].text == text

    def attribute(self, i: int, close: int) -> dict:
        """Facts of the attribute between ``[`` at i and ``]`` at close."""
        words, j = [], i + 1
        while j < close and (self.t[j].kind == "word" or self.t[j].text == "::"):
            words.append(self.t[j].text)
            j += 1
        name = words[-1] if words else ""
        inner = self.t[j:close]
        found = {"test": name == "test" or (name == "cfg" and any("test" in t.text for t in inner)), "paths": [], "sure": False}
        if name == "path" and len(inner) >= 2 and inner[0].text == "=" and inner[1].kind == "text":
            found["paths"], found["sure"] = [literal(inner[1])], True
        elif name == "cfg_attr":
            for a, b, c in zip(inner, inner[1:], inner[2:], strict=False):
                if a.text == "path" and b.text == "=" and c.kind == "text":
                    found["paths"].append(literal(c))
        return found

    def skip(self, i: int, end: int, stops: str) -> int:
        """First place from i at which one of the signs stands outside brackets."""
        while i < end:
            t = self.t[i]
            if t.kind == "sign" and t.text in stops:
                return i
            i = self.match[i] + 1 if t.kind == "sign" and t.text in CLOSES else i + 1
        return end

    def items(self, i: int, end: int, parent: dict | None, prefix: list[str], tested: bool, folder: str, members: bool) -> None:
        while i < end:
            first, test, found, sure = i, tested, [], False
            while self.is_sign(i, "#", end):
                inner = self.is_sign(i + 1, "!", end)
                at = i + 1 + inner
                if not self.is_sign(at, "[", end):
                    raise RustSyntaxError(f"bad attribute at line {self.t[i].line}")
                facts = self.attribute(at, self.match[at])
                if not inner:
                    test = test or facts["test"]
                    found += [p for p in facts["paths"] if p is not None]
                    sure = sure or facts["sure"]
                i = self.match[at] + 1
                if inner:
                    first = i
            if i >= end:
                return
            if self.is_sign(i, ";", end):
                i += 1
                continue
            seen = "inherited" if members else "private"
            if self.t[i].text == "pub" or self.t[i].text == "crate":
                seen, i = "pub", i + 1
                if self.is_sign(i, "(", end):
                    seen = "pub(" + " ".join(t.text for t in self.t[i + 1 : self.match[i]]).replace(" :: ", "::") + ")"
                    i = self.match[i] + 1
            i = self.item(i, first, end, parent, prefix, test, folder, members, seen, found, sure)

    def item(self, i, first, end, parent, prefix, test, folder, members, seen, found, sure) -> int:
        t = self.t
        while i < end and t[i].text in MODIFIERS and not (t[i].text == "const" and self._names_constant(i, end)):
            if t[i].text == "extern":
                if i + 1 < end and t[i + 1].text == "crate":
                    return self.skip(i, end, ";") + 1
                if i + 1 < end and t[i + 1].kind == "text":
                    i += 1
                if self.is_sign(i + 1, "{", end):
                    close = self.match[i + 1]
                    self.push("ForeignMod", f"extern@{t[first].line}:{t[first].column}", first, close, parent, prefix, test, seen)
                    return close + 1
            i += 1
        if i >= end:
            raise RustSyntaxError("item expected at the end")
        word = t[i].text
        if t[i].kind == "word" and i + 1 < end and t[i + 1].text in ("!", "::") and word not in HEADS:
            j = i
            name = word
            while j < end and t[j].text != "!":
                name = t[j].text if t[j].kind == "word" else name
                j += 1
            j += 1
            if j < end and t[j].kind == "word":  # macro_rules! name
                name, j = t[j].text, j + 1
            if j >= end or t[j].text not in CLOSES:
                raise RustSyntaxError(f"macro body expected at line {t[i].line}")
            close = self.match[j]
            last = close + 1 if t[j].text != "{" and self.is_sign(close + 1, ";", end) else close
            self.push("Macro", name, first, last, parent, prefix, test, seen)
            return last + 1
        if t[i].kind != "word" or word not in HEADS:
            raise RustSyntaxError(f"item expected at line {t[i].line}, found {word!r}")
        kind = HEADS[word]
        place = f"{word}@{t[first].line}:{t[first].column}"
        if kind == "Use":
            stop = self.skip(i, end, ";")
            self.push(kind, place, first, min(stop, end - 1), parent, prefix, test, seen)
            return stop + 1
        if kind == "Impl":
            body = self.skip(i + 1, end, "{;")
            return self.block(kind, place, first, body, end, parent, prefix, test, seen, folder, True)
        at = i + 1
        if kind == "Static" or kind == "Const":
            at += at < end and t[at].text == "mut"
        if at >= end or t[at].kind != "word":
            raise RustSyntaxError(f"name expected at line {t[i].line}")
        name = t[at].text.removeprefix("r#")
        if kind in ("Const", "Static", "TypeAlias"):
            stop = self.skip(at, end, ";")
            self.push(kind if not members else "AssocItem", name, first, min(stop, end - 1), parent, prefix, test, seen)
            return stop + 1
        stop = self.skip(at, end, "{;=" if kind == "Trait" else "{;")
        if kind == "Mod":
            if self.is_sign(stop, ";", end):
                made = self.push(kind, name, first, stop, parent, prefix, test, seen)
                self.declare(made, name, found, sure, folder)
                return stop + 1
            inner = f"{folder}/{found[0] if found else name}".lstrip("/")
            return self.block(kind, name, first, stop, end, parent, prefix, test, seen, inner, False)
        if kind == "Trait" and self.is_sign(stop, "=", end):
            stop = self.skip(stop, end, ";")
            self.push("TraitAlias", name, first, min(stop, end - 1), parent, prefix, test, seen)
            return stop + 1
        if kind == "Trait":
            return self.block(kind, name, first, stop, end, parent, prefix, test, seen, folder, True)
        close = self.match[stop] if stop < end and t[stop].text == "{" else min(stop, end - 1)
        self.push("AssocItem" if members else kind, name, first, close, parent, prefix, test, seen)
        return close + 1

    def _names_constant(self, i: int, end: int) -> bool:
        """Whether ``const`` at i is followed by a name (or ``mut``) rather than ``fn``."""
        return i + 1 < end and self.t[i + 1].text not in ("fn", "unsafe", "async", "extern")

    def block(self, kind, name, first, body, end, parent, prefix, test, seen, folder, members) -> int:
        if body >= end or self.t[body].text != "{":
            raise RustSyntaxError(f"body expected at line {self.t[first].line}")
        close = self.match[body]
        made = self.push(kind, name, first, close, parent, prefix, test, seen)
        self.items(body + 1, close, made, [*prefix, name], test, folder, members)
        return close + 1

    def push(self, kind, name, first, last, parent, prefix, test, seen) -> dict:
        a, b = self.t[first], self.t[last]
        made = {
            "kind": kind, "name": "::".join([*prefix, name]), "visibility": seen, "is_test": test,
            "span": (a.line, a.column, b.end_line, b.end_column), "parent": parent,
        }
        self.out.items.append(made)
        return made

    def declare(self, made: dict, name: str, found: list[str], sure: bool, folder: str) -> None:
        here = self.path.rpartition("/")[0]
        targets = [normalize(f"{here}/{p}") for p in found]
        if not sure:
            targets += [normalize(f"{folder}/{name}.rs"), normalize(f"{folder}/{name}/mod.rs")]
        kept = list(dict.fromkeys(p for p in targets if p))
        self.out.modules.append({"item": made, "targets": kept})
        if found:
            self.out.sources += [(p, "path_module") for p in kept]

    def includes(self) -> None:
        t, here = self.t, self.path.rpartition("/")[0]
        for i in range(len(t) - 4):
            if t[i].text in INCLUDES and t[i + 1].text == "!" and t[i + 2].text in CLOSES and t[i + 3].kind == "text":
                close = self.match[i + 2]
                if close == i + 4 or (close == i + 5 and t[i + 4].text == ","):
                    value = literal(t[i + 3])
                    target = normalize(f"{here}/{value}") if value and not value.startswith("/") else None
                    if target:
                        self.out.sources.append((target, INCLUDES[t[i].text]))


def normalize(path: str) -> str | None:
    """Lexical form of a path from the repository's root; null if it escapes."""
    out: list[str] = []
    for part in path.split("/"):
        if part == "..":
            if not out:
                return None
            out.pop()
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def module_folder(path: str) -> str:
    """Directory in which a file's child modules lie."""
    folder, _, name = path.rpartition("/")
    return folder if name in ("mod.rs", "lib.rs", "main.rs", "build.rs") else f"{folder}/{name.removesuffix('.rs')}".lstrip("/")


def parse(text: str, path: str) -> Parsed:
    walker = Walker(text, path)
    walker.items(0, len(walker.t), None, [], False, module_folder(path), False)
    walker.includes()
    return walker.out
