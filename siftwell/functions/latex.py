"""LaTeX sources as Markdown: a stack of groups and environments, and macros that the source defines.

What stands for text is kept: headings, emphasis, lists, links, accents, formulas as they are written.
Comments, labels, citations, figures and settings go. Malformed sources give what could be read, and a fault.
"""

from __future__ import annotations

import re
import unicodedata

#: Macro calls and groups within each other after which a source counts as malformed.
MOST_CALLS, MOST_DEPTH = 100_000, 200

# What LaTeX's commands stand for.
HEADINGS = {"part": "#", "chapter": "#", "section": "#", "subsection": "##", "subsubsection": "###", "paragraph": "####", "title": "#"}
MARKS = {"emph": "*", "textit": "*", "textsl": "*", "textbf": "**", "texttt": "`"}
ACCENTS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "=": "\u0304", ".": "\u0307", "c": "\u0327", "v": "\u030c", "u": "\u0306", "H": "\u030b", "r": "\u030a", "k": "\u0328"}
SYMBOLS = {
    "ss": "\u00df", "o": "\u00f8", "O": "\u00d8", "l": "\u0142", "L": "\u0141", "ae": "\u00e6", "AE": "\u00c6", "oe": "\u0153", "OE": "\u0152", "aa": "\u00e5", "AA": "\u00c5", "i": "\u0131", "j": "\u0237",
    "ldots": "...", "dots": "...", "textbackslash": "\\", "textasciitilde": "~", "textasciicircum": "^", "textbar": "|", "textless": "<", "textgreater": ">", "LaTeX": "LaTeX", "TeX": "TeX", "S": "\u00a7", "copyright": "\u00a9", "pounds": "\u00a3", "quad": " ", "qquad": " ", "newline": "\n", "par": "\n\n",
}
#: Arguments of these go with them, so many of each; of others that aren't known the arguments stay as text.
DROPPED = {
    "label": 1, "ref": 1, "eqref": 1, "pageref": 1, "cite": 1, "citep": 1, "citet": 1, "bibliography": 1, "bibliographystyle": 1, "usepackage": 1, "documentclass": 1, "includegraphics": 1, "input": 1, "include": 1, "vspace": 1, "hspace": 1, "pagestyle": 1, "thispagestyle": 1,
    "setlength": 2, "setcounter": 2, "addtocounter": 2, "newtheorem": 2, "index": 1, "thanks": 1, "footnotemark": 0, "date": 1, "author": 1,
}
FORMULAS = {"equation", "equation*", "align", "align*", "eqnarray", "eqnarray*", "displaymath", "gather", "gather*", "multline", "multline*", "math"}
SKIPPED = {"figure", "figure*", "table", "table*", "tabular", "thebibliography", "picture", "comment"}
VERBATIM = {"verbatim", "lstlisting"}
LISTS = {"itemize": "- ", "enumerate": "1. ", "description": "- "}

TOKEN = re.compile(r"\\([A-Za-z@]+\*?|.)[ \t]*|([{}$%&~^_#])|(``|''|---|--)", re.S)
END = {name: re.compile(r"\\end\s*\{" + re.escape(name) + r"\}") for name in FORMULAS | SKIPPED | VERBATIM}


class Fault(ValueError):
    """What makes a source malformed."""


class Reader:
    """A source read from left to right; macro calls put their expansion in front of what is left."""

    def __init__(self, source: str):
        self.source, self.at, self.macros, self.calls = source, 0, {}, 0
        self.stack: list[tuple[str, str]] = []
        self.out: list[str] = []

    def spaces(self) -> None:
        while self.at < len(self.source) and self.source[self.at] in " \t\n":
            self.at += 1

    def group(self) -> str | None:
        """The next argument: what stands in braces, a command, or a character; None at the end of the source."""
        self.spaces()
        if self.at >= len(self.source):
            return None
        if self.source[self.at] != "{":
            found = TOKEN.match(self.source, self.at) if self.source[self.at] == "\\" else None
            text = found.group(0).rstrip() if found else self.source[self.at]
            self.at += len(text)
            return text
        depth, begin = 0, self.at + 1
        while self.at < len(self.source):
            c = self.source[self.at]
            depth += (c == "{") - (c == "}")
            self.at += 2 if c == "\\" else 1
            if not depth:
                return self.source[begin : self.at - 1]
        raise Fault("a group isn't closed")

    def option(self) -> str | None:
        """What stands in the brackets that come next, if there are any."""
        if self.at < len(self.source) and self.source[self.at] == "[":
            end = self.source.find("]", self.at)
            if end < 0:
                raise Fault("an option isn't closed")
            text, self.at = self.source[self.at + 1 : end], end + 1
            return text
        return None

    def define(self, command: str) -> None:
        """newcommand{\\name}[n][default]{body} and def\\name#1#2{body}."""
        if command == "def":
            self.spaces()
            found = re.compile(r"\\([A-Za-z@]+|.)((?:#\d)*)\s*").match(self.source, self.at)
            if not found:
                raise Fault("a definition has no name")
            self.at = found.end()
            name, n, default = found.group(1), len(found.group(2)) // 2, None
        else:
            name = (self.group() or "").strip().lstrip("\\")
            number = self.option()
            n, default = int(number) if number and number.isdigit() else 0, self.option()
        body = self.group()
        if not name or body is None:
            raise Fault("a definition is cut off")
        if command != "providecommand" or name not in self.macros:
            self.macros[name] = (n, default, body)

    def call(self, name: str) -> None:
        n, default, body = self.macros[name]
        self.calls += 1
        if self.calls > MOST_CALLS:
            raise Fault("macros call each other without end")
        args = []
        for k in range(n):
            given = self.option() if k == 0 and default is not None else None
            args.append(default if k == 0 and default is not None and given is None else given if given is not None else self.group() or "")
        text = re.sub(r"#(\d)", lambda m: args[int(m.group(1)) - 1] if 0 < int(m.group(1)) <= n else "", body)
        self.source, self.at = text + self.source[self.at :], 0

    def inner(self, text: str) -> str:
        """The text of an argument."""
        if len(self.stack) > MOST_DEPTH:
            raise Fault("groups are too deep")
        own = Reader(text)
        own.macros, own.calls, own.stack = self.macros, self.calls, [*self.stack, ("arg", "")]
        own.run()
        self.calls = own.calls
        return "".join(own.out)

    def until(self, name: str) -> str:
        found = END[name].search(self.source, self.at)
        if not found:
            raise Fault(f"{name} isn't closed")
        text, self.at = self.source[self.at : found.start()], found.end()
        return text

    def begin(self) -> None:
        name = (self.group() or "").strip()
        if name in FORMULAS:
            self.out.append(f"\n\n$${self.until(name).strip()}$$\n\n")
        elif name in VERBATIM:
            body = self.until(name).strip("\n")
            self.out.append(f"\n\n```\n{body}\n```\n\n")
        elif name in SKIPPED:
            self.until(name)
        else:
            self.option()
            if len(self.stack) > MOST_DEPTH:
                raise Fault("environments are too deep")
            self.stack.append(("env", name))
            if name == "document":
                self.out.clear()  # what stands before it is no text

    def end(self) -> None:
        name = (self.group() or "").strip()
        while self.stack and self.stack[-1] == ("group", ""):
            self.stack.pop()
        if not self.stack or self.stack[-1] != ("env", name):
            raise Fault(f"{name} ends that didn't begin")
        self.stack.pop()
        if name == "document":
            self.at = len(self.source)
        elif name in LISTS:
            self.out.append("\n\n")

    def command(self, name: str) -> None:
        plain = name.rstrip("*")
        if plain in self.macros:
            self.call(plain)
        elif plain in ("newcommand", "renewcommand", "providecommand", "def"):
            self.define(plain)
        elif plain == "begin":
            self.begin()
        elif plain == "end":
            self.end()
        elif plain in HEADINGS:
            self.option()
            self.out.append(f"\n\n{HEADINGS[plain]} {self.inner(self.group() or '').strip()}\n\n")
        elif plain in MARKS:
            mark = MARKS[plain]
            self.out.append(f"{mark}{self.inner(self.group() or '').strip()}{mark}")
        elif plain == "item":
            label = self.option()
            kind = next((LISTS[n] for k, n in reversed(self.stack) if k == "env" and n in LISTS), "- ")
            self.out.append(f"\n{kind}" + (f"**{self.inner(label)}** " if label else ""))
        elif plain == "href":
            target, text = self.group() or "", self.inner(self.group() or "")
            self.out.append(f"[{text}]({target})")
        elif plain == "url":
            self.out.append(f"<{self.group() or ''}>")
        elif plain == "footnote":
            self.out.append(f" ({self.inner(self.group() or '').strip()})")
        elif plain in ACCENTS:
            letter = self.inner(self.group() or "").replace("\u0131", "i").replace("\u0237", "j")
            self.out.append(unicodedata.normalize("NFC", letter[:1] + ACCENTS[plain]) + letter[1:] if letter else "")
        elif plain in SYMBOLS:
            self.out.append(SYMBOLS[plain])
            if self.source.startswith("{}", self.at):
                self.at += 2
        elif plain in DROPPED:
            for _ in range(DROPPED[plain]):
                self.option()
                self.group()
        elif name == "\\":
            self.option()
            self.out.append("\n")
        elif name in ("(", "["):
            close = self.source.find("\\)" if name == "(" else "\\]", self.at)
            if close < 0:
                raise Fault("a formula isn't closed")
            dollars = "$" if name == "(" else "$$"
            self.out.append(f"{dollars}{self.source[self.at : close].strip()}{dollars}")
            self.at = close + 2
        elif name in "{}$&#_%":
            self.out.append(name)
        elif name in " \n\t,;:!/@-":
            self.out.append(" " if name in " \n\t,;:" else "")

    def formula(self) -> None:
        dollars = "$$" if self.source.startswith("$", self.at) else "$"
        self.at += len(dollars) - 1
        close = self.source.find(dollars, self.at)
        if close < 0:
            raise Fault("a formula isn't closed")
        self.out.append(f"{dollars}{self.source[self.at : close].strip()}{dollars}")
        self.at = close + len(dollars)

    def run(self) -> None:
        depth = len(self.stack)
        while self.at < len(self.source):
            found = TOKEN.search(self.source, self.at)
            if not found:
                self.out.append(self.source[self.at :])
                break
            self.out.append(self.source[self.at : found.start()])
            self.at = found.end()
            name, char, quote = found.groups()
            if name is not None:
                if name[:1].isalpha() is False:
                    self.at = found.start() + 2  # spaces after a sign are text
                self.command(name)
            elif quote:
                self.out.append({"``": "\u201c", "''": "\u201d", "--": "\u2013", "---": "\u2014"}[quote])
            elif char == "{":
                self.stack.append(("group", ""))
            elif char == "}":
                if len(self.stack) <= depth or self.stack[-1][0] != "group":
                    raise Fault("a group ends that didn't begin")
                self.stack.pop()
            elif char == "%":
                line = self.source.find("\n", self.at)
                rest = len(self.source) if line < 0 else line + 1
                while rest < len(self.source) and self.source[rest] in " \t":
                    rest += 1
                self.at = rest
            elif char == "$":
                self.formula()
            elif char == "~":
                self.out.append(" ")
            elif char == "&":
                self.out.append(" | ")
            else:
                self.out.append(char)
        if len(self.stack) > depth:
            raise Fault(f"{self.stack[-1][1] or 'a group'} isn't closed")


def tidy(text: str) -> str:
    """Paragraphs with one empty line between, and no spaces in a row; what stands between fences stays."""
    parts = text.split("```")
    for k in range(0, len(parts), 2):
        parts[k] = re.sub(r"[ \t]*\n[ \t]*(?:\n[ \t]*)+", "\n\n", re.sub(r"[ \t\r\f\v]+", " ", parts[k]))
        parts[k] = re.sub(r"(?<!\n) *\n(?!\n|- |1\. ) *", " ", parts[k]) if k % 2 == 0 else parts[k]
    return "```".join(parts).strip(" \n")


def to_markdown(source: str) -> tuple[str, str | None]:
    """(Markdown, fault): of a malformed source, what was read before the fault."""
    reader, fault = Reader(source), None
    try:
        reader.run()
    except (Fault, RecursionError) as e:
        fault = str(e) or "groups are too deep"
    return tidy("".join(reader.out)), fault
