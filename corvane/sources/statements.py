"""A file as statements: what stands between separators, with bracketed parts folded away.

``head`` is a statement's tokens joined by spaces, where a bracketed part is only its
two brackets and a string only two quotes, so a pattern over heads never meets the
inside of either.  Blocks that can hold declarations are read as statements of their
own; ``above`` has the heads around one, outermost first.  One walk over the tokens
with a stack of open brackets; comments and strings are tokens, so brackets in them
count for nothing.  Brackets that close nothing are passed over.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: n numbers a file's statements; root is the outermost statement a name in a list belongs to; group is the text of the first round brackets.
SCHEMA = "file_path string, language string, n int, root int, above array<string>, head string, texts array<string>, `group` string, signature string, start_line int, end_line int"

#: Languages in which a line end can end a statement.
BY_LINE = frozenset(("typescript", "javascript", "go", "kotlin", "swift"))
_STRINGS = {
    "typescript": r"'(?:[^'\\\n]|\\.)*+'?|`(?:[^`\\]|\\.)*+`?",
    "go": r"`[^`]*+`?|'(?:\\[^'\n]+|[^'\\\n])'",
    "rust": r'br?"(?:[^"\\]|\\.)*+"?|r(?P<hash>\#+)".*?(?:"(?P=hash)|\Z)|r"[^"]*+"?|"(?:[^"\\]|\\.)*+"?|' + r"'(?:\\[^'\n]+|[^'\\\n])'",
    "csharp": r'\$*@\$*"(?:[^"]|"")*+"?|\$?"""+.*?(?:"""+|\Z)|\$"(?:[^"\\\n]|\\.)*+"?|' + r"'(?:\\[^'\n]+|[^'\\\n])'",
}
_LONG = r'"""(?:.*?)(?:"""|\Z)|' + r"'(?:\\[^'\n]+|[^'\\\n])'"


def _lexer(language: str) -> re.Pattern:
    gone = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    if language in ("csharp", "swift"):
        gone += r"|^[ \t]*\#[a-z][^\n]*"
    strings = _STRINGS.get("typescript" if language == "javascript" else language, _LONG)
    names = r"\#?[\w$]+" if language in ("typescript", "javascript") else r"\w+"
    return re.compile(rf'(?P<gone>{gone})|(?P<text>{strings}|"(?:[^"\\\n]|\\.)*+"?)|(?P<word>{names})|(?P<line>\n)|(?P<sign>=>|->|::|\?\.|&&|\|\||==|[^\s\w])', re.S | re.M)


LANGUAGES = ("typescript", "javascript", "go", "rust", "java", "kotlin", "csharp", "swift")
_LEXERS = {x: _lexer(x) for x in LANGUAGES}
#: Heads whose braces hold declarations, or names of an import.
_NAMES = r"^(?:import|export)(?: type)?(?: \w+ ,)? \{$"
_HOLDS = {
    "typescript": rf"{_NAMES}|(?:^| )class(?: |$)", "rust": r"^(?:# \[ \] |pub |\( \) |unsafe |auto )*(?:trait|impl)\b|^(?:# \[ \] |pub |\( \) )*use ", "java": r"(?:^| )(?:class|interface|enum|record)(?: |$)",
    "kotlin": r"(?:^| )(?:class|interface|object)(?: |$)", "csharp": r"(?:^| )(?:namespace|class|record|struct|interface|enum)(?: |$)", "swift": r"(?:^| )(?:class|struct|enum|protocol|extension|actor)(?: |$)",
}
_HOLDS["javascript"] = _HOLDS["typescript"]
_HOLDS = {k: re.compile(v) for k, v in _HOLDS.items()}
_LISTS = re.compile(rf"{_NAMES}|^(?:# \[ \] |pub |\( \) )*use ")
_ENUM = re.compile(r"(?:^| )enum ")
_ONLY_MARKS = re.compile(r"(?:@ \w+(?: \. \w+)*(?: \( \))?(?: |$))+$")
_RUST_MARKS = re.compile(r"#(?: !)?(?: \[(?: \])?)?(?: #(?: !)?(?: \[(?: \])?)?)*$")
_GOES_ON_AFTER = frozenset(", = < : -> => + - * / && || | & . ?. :: == extends implements where".split())
_GOES_ON_WITH = frozenset(". ?. = : -> => where extends implements | & ? && || , else catch finally as from throws".split())
_AFTER_BLOCK = frozenset("; , . ?. from as & | = else catch finally -> :: ? ) ]".split())
#: Words one of which stands in every statement that is an import.
_IMPORT_WORDS = {"rust": ("use",), "csharp": ("using",), "typescript": ("import", "from", "require")}
_IMPORT_WORDS["javascript"] = _IMPORT_WORDS["typescript"]
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_KEYS = frozenset("class interface enum record object namespace struct protocol extension actor trait impl use import export const var type".split())


class _Statement:
    __slots__ = ("n", "root", "above", "head", "texts", "group", "start", "end", "brace", "marked", "keyed")

    def __init__(self, n, root, above, start, seed):
        self.n, self.root, self.above, self.start, self.end = n, n if root < 0 else root, above, start, start
        self.head, self.texts, self.group, self.brace, self.marked, self.keyed = list(seed), [], None, None, False, bool(seed)


class _Frame:
    __slots__ = ("close", "read", "commas", "seed", "above", "root", "line_of", "now", "soft", "begin")

    def __init__(self, close, read, begin, above=(), commas=False, seed=(), root=-1):
        self.close, self.read, self.begin, self.above, self.commas, self.seed, self.root = close, read, begin, above, commas, seed, root
        self.now, self.soft, self.line_of = None, None, None


def imports_end(text: str, language: str) -> int:
    """Where the last word ends that can belong to an import, in code or not; -1 if there is none."""
    end = -1
    for word in _IMPORT_WORDS.get(language, ("import",)):
        at = text.rfind(word)
        while at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_"):
            at = text.rfind(word, 0, at)
        end = max(end, at + len(word) if at >= 0 else -1)
    return end


def statements(text: str, language: str, only_imports: bool = False) -> list[tuple]:
    """Rows of ``SCHEMA`` after file_path and language, in order of place.

    ``only_imports``: what stands after the statements that are open at the last word of an import is left out, as it holds none.
    """
    lexer, by_line, holds = _LEXERS[language], language in BY_LINE, _HOLDS.get(language)
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(breaks, at) + 1
    done: list[_Statement] = []
    stack, open_ = [_Frame("", True, 0)], Counter()
    size, at, last, before, loose = len(text), 0, "", "", 0
    enough, waited = imports_end(text, language) if only_imports else size, []
    if enough < 0:
        return []

    def finish(frame: _Frame) -> None:
        if frame.now is not None:
            if language == "csharp" and frame.now.head[:1] == ["namespace"] and frame.now.brace is None:
                frame.above = (*frame.above, " ".join(frame.now.head))  # holds for the rest of the file
            done.append(frame.now)
        frame.now = frame.soft = None

    def begun(frame: _Frame, start: int) -> _Statement:
        nonlocal loose
        if frame.now is None:
            frame.now = _Statement(loose, frame.root, frame.above, start if frame.line_of is None else frame.line_of, frame.seed)
            loose += 1
        return frame.now

    while at < size and (m := lexer.search(text, at)):
        if at >= enough:
            waited = [(f, s) for f, s in waited or [(f, f.now) for f in stack] if s is not None and f.now is s]
            if not waited:
                stack = []  # what has begun since is no import
                break
        kind, token, at = m.lastgroup if m.lastgroup != "hash" else "text", m[0], m.end()
        if kind == "gone":
            continue
        frame = stack[-1]
        now = frame.now
        if kind == "line":
            if by_line and now is not None and not frame.soft and (last not in _GOES_ON_AFTER or language in ("kotlin", "swift") and now.head[0] == "import") and not (now.head[0] == "@" and _ONLY_MARKS.match(" ".join(now.head))):
                frame.soft = "line"
            continue
        if now is not None and frame.soft:
            on = token in (_GOES_ON_WITH if frame.soft == "line" else _AFTER_BLOCK) or token == "{" and (frame.soft == "line") != (language == "go") or token == "(" and language == "go" and frame.soft == "block"
            frame.soft = None
            if not on:
                finish(frame)
        if token == "/" and language in ("typescript", "javascript") and (last in _GOES_ON_AFTER or last in ("", "(", "[", "{", "}", ";", "!", "?", "return")):
            if r := re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*").match(text, m.start()):
                kind, token, at = "text", r[0], r.end()
        if language in ("typescript", "javascript") and kind == "text" and last == "(" and before == "require":
            done.append(found := _Statement(loose, -1, (), m.start(), ["require", '""']))
            found.texts, found.end, loose = [token], at, loose + 1
        before, last = last, token
        if token in _PAIRS and kind == "sign":
            inner = _Frame(_PAIRS[token], False, at)
            if frame.read:
                now = begun(frame, m.start())
                now.head.append(token)
                head = " ".join(now.head) if now.keyed and token != "[" else ""  # others hold nothing to read, however many brackets they have
                if token == "{":
                    now.brace = m.start() if now.brace is None else now.brace
                    if holds and holds.search(head):
                        named = _LISTS.search(head)
                        inner.read, inner.commas = True, bool(named) or language in ("java", "csharp") and bool(_ENUM.search(head))
                        inner.above = frame.above if named else (*frame.above, head)
                        inner.seed = () if not named else (*now.head[:-1],) if language == "rust" else ("name",)
                        inner.root, inner.line_of = (now.root, now.start) if named else (-1, None)  # a name stands where its import begins
                elif token == "(" and language == "go" and head in ("const (", "var (", "type (", "import ("):
                    inner.read, inner.seed = True, (now.head[0],)
            stack.append(inner)
            open_[inner.close] += 1
            continue
        if token in (")", "]", "}") and kind == "sign":
            if not open_[token]:
                continue
            while True:  # what was left open ends here
                inner = stack.pop()
                open_[inner.close] -= 1
                finish(inner)
                if inner.close == token:
                    break
            frame = stack[-1]
            if frame.now is not None:
                frame.now.head.append(token)
                frame.now.end = at
                if token == ")" and frame.now.group is None:
                    frame.now.group = text[inner.begin : m.start()]
                frame.soft = "block" if token == "}" else None
            continue
        if not frame.read:
            continue
        if token == ";" or token == "," and frame.commas:
            if frame.now is not None:
                frame.now.end = at if token == ";" else frame.now.end
                finish(frame)
            continue
        now = begun(frame, m.start())
        if language == "rust" and not now.marked and len(now.head) > len(frame.seed):
            if not _RUST_MARKS.match(" ".join(now.head[len(frame.seed) :])):
                now.marked = True
            elif token not in ("#", "!"):
                now.start, now.marked = m.start(), True  # attributes stand before an item, not in it
        now.head.append('""' if kind == "text" else token)
        if kind == "text":
            now.texts.append(token)
        elif token in _KEYS:
            now.keyed = True
        now.end = at
    for frame in reversed(stack):
        finish(frame)
    done.sort(key=lambda s: s.n)
    cut = lambda s: " ".join(text[s.start : s.brace if s.brace is not None and s.brace > s.start else s.end].split()).rstrip("{; ")
    return [(s.n, s.root, list(s.above), " ".join(s.head), s.texts, s.group, cut(s), line(s.start), line(max(s.start, s.end - 1))) for s in done]


def read(files: DataFrame, only_imports: bool = False) -> DataFrame:
    """The statements of files (path, language, content) in the languages read here; ``only_imports``: those that can be imports, at least."""
    names = [x.split()[0].strip("`") for x in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.int32()]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for path, language, text in ((c[i].as_py() for c in batch.columns) for i in range(batch.num_rows)):
                rows = [(path, language, *s) for s in statements(text or "", language, only_imports)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    own = files.select("path", "language", "content")
    return own.where(own["language"].isin(*LANGUAGES)).mapInArrow(run, SCHEMA)
