"""Markup residue: a tree of possible constructs, boosted trees over its nodes, hierarchical decoding.

A text is scanned for everything that may be a construct of HTML, Markdown, wiki or LaTeX markup, well
formed or broken, and for signs that are often plain text.  The finds form a tree by nesting.  Boosted
trees judge each node by its kind, closing, attributes, surroundings, depth, siblings and subtree; decoding
from the root then takes the most likely labelling in which nothing inside code, a formula or a comment is
markup of its own.  What is left as markup is turned into clean text.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .examples import PLAIN, PLAIN_LINES

#: Training texts that the classifier is fitted on; each is written and labelled by a grammar.
TRAINING_TEXTS = 4000

# Element names of HTML, and commands of LaTeX, that are common in text.
HTML_NAMES = frozenset(
    "a abbr article aside b big blockquote body br button caption center cite code col dd del details div dl dt em figcaption figure font "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav nowiki ol option p param pre q ref "
    "references s samp script section select small source span strike strong style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var video".split()
)
VOID = frozenset("br hr img input meta link col source param".split())
LATEX_NAMES = frozenset(
    "textbf textit texttt textsc textrm textsf emph underline section subsection subsubsection paragraph chapter part cite citep citet ref eqref pageref label "
    "footnote url href begin end item title author date caption includegraphics documentclass usepackage newcommand maketitle tableofcontents bibliography "
    "centering hline frac sqrt sum alpha beta gamma leq geq cdot times noindent newpage clearpage bf it".split()
)

#: Kinds of node; those from ``weak`` on are signs that are plain text more often than not.
KINDS = (
    "comment tag entity fence code formula environment command quoted wikilink template wikitable image link footnote wikiheading setext heading "
    "tablerule tablerow quote strong emphasis wikiemphasis strike weak list"
).split()
KIND = {k: i for i, k in enumerate(KINDS)}
#: Nodes whose inside is literal.
LITERAL = frozenset(KIND[k] for k in ("comment", "fence", "code", "formula"))

#: Constructs that take a line, or begin one.
_LINE = re.compile(
    r"""
    (?P<fence>(?P<f>```|~~~)[^\n`]*\n(?:.*?^(?P=f)[`~]*[ \t]*$|.*\Z)|(?:```|~~~)[^\n`]*$)
  | (?P<wikitable>\{\|[^\n]*|\|\}|\|-+[ \t]*$)
  | (?P<wikiheading>(?P<w>={1,6})[ \t]*[^=\s][^\n]*?(?P=w)[ \t]*$)
  | (?P<heading>\#{1,6}[ \t]+\S[^\n]*$)
  | (?P<tablerule>[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$)
  | (?P<tablerow>[ \t]*(?:\||!(?!\[))[^|\n](?:[^\n]*\|)?[^\n]*$)
  | (?P<quote>>[ \t]?(?=\S))
  | (?P<list>[ \t]*(?:[-*+]|\d{1,3}[.)])[ \t]+(?=\S))
""",
    re.X | re.M | re.S,
)
#: Constructs within a line, and signs that are often plain text.
_INLINE = re.compile(
    r"""
    (?P<comment><!--(?:.*?-->|[^\n]*))
  | (?P<tag></?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|<[A-Za-z][A-Za-z0-9]*\s+[A-Za-z-]+=["'][^<>\n]*|</[A-Za-z][A-Za-z0-9]*)
  | (?P<entity>&(?:\#\d+|\#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);)
  | (?P<formula>\$\$[^$]+\$\$|\$(?![\s$])[^$\n]*?(?<![\s$])\$(?!\d))
  | (?P<environment>\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?)
  | (?P<command>\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{?)
  | (?P<code>`[^`\n]+`)
  | (?P<wikilink>\[\[[^\[\]\n]*\]\]|\[\[(?=\w))
  | (?P<template>\{\{[^{}]*\}\}|\{\{(?=\w)|(?<=\w)\}\})
  | (?P<image>!\[[^\]\n]*\]\([^()\n]*\)|!\[[^\]\n]*\]\[[^\]\n]*\])
  | (?P<footnote>\[\^[^\]\s]+\]:?)
  | (?P<link>\[[^\[\]\n]+\]\([^()\s]*(?:[ ]"[^"\n]*")?\)|\[[^\[\]\n]+\]\([^()\s]*$|\[https?://[^\]\n]+\])
  | (?P<strong>\*\*(?=\S)(?:[^*\n]|\n(?!\n))+?(?<=\S)\*\*|(?<!\w)__(?=\S)(?:[^_\n]|\n(?!\n))+?(?<=\S)__(?!\w)|(?<!\w)(?:\*\*|__)(?=\w)|(?<=\w)\*\*(?!\w))
  | (?P<strike>~~(?=\S)(?:[^~\n]|\n(?!\n))+?(?<=\S)~~|~~(?=\w))
  | (?P<wikiemphasis>'{3}(?=\w))
  | (?P<emphasis>(?<![\w*])\*(?=[^\s*])(?:[^*\n]|\n(?!\n))*?(?<=[^\s*])\*(?![\w*])|(?<![\w_])_(?=[^\s_])(?:[^_\n]|\n(?!\n))*?(?<=[^\s_])_(?![\w_]))
  | (?P<weak><[-=<]*\d*|[-=]+>|\$\d*|={1,3}|_\w*|\*+|\#+\d*|~+\d*|\\\W?|\[|\^|&\w?|\{+|\}+|\||>|`+|''?)
""",
    re.X | re.M | re.S,
)
#: Places at which one of the two is worth trying.
_TRIGGER = re.compile(r"^(?=[ \t]*[`~{|=#:>!*+\-\d])|[<&$\\`{*_~\[]|\}\}|''|!\[|[-=]>|\^|(?<=\s)[=|>]|#", re.M)
_SETEXT = re.compile(r"^[^\n]*\S[^\n]*\n(?:={3,}|-{3,})[ \t]*$", re.M)


#: Constructs that end with their own closing sign, however far it is within the paragraph.
_PAIRED = (("``", "''", "quoted"), ("'''", "'''", "wikiemphasis"), ("''", "''", "wikiemphasis"), ("\\(", "\\)", "formula"), ("\\[", "\\]", "formula"))


class _Text:
    """A text with what is looked up in it again and again, each found once."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._next: dict[str, int] = {}
        self._braces: dict[int, int] | None = None

    def following(self, sign: str, at: int) -> int:
        """Where ``sign`` next stands from ``at`` on, the text's length if nowhere; calls come with rising places."""
        known = self._next.get(sign, -1)
        if known < at:
            known = self.text.find(sign, at)
            self._next[sign] = known = len(self.text) if known < 0 else known
        return known

    def closed(self, start: int, stop: int) -> tuple[str, int] | None:
        """(kind, end) of a construct of ``_PAIRED`` that starts here."""
        for opening, closing, kind in _PAIRED:
            if self.text.startswith(opening, start):
                inside = start + len(opening)
                first = self.text[inside : inside + 1]
                if kind != "formula" and (not first or first.isspace() or first == opening[0]):
                    continue
                end = self.following(closing, inside + (kind != "formula")) + len(closing)
                if end <= min(stop, self.following("\n\n", inside)):
                    return kind, end
        return None

    def brace(self, at: int) -> int | None:
        """The closing brace of the opening one at ``at``."""
        if self._braces is None:
            self._braces, waiting = {}, []
            for m in re.finditer(r"\\[\s\S]|[{}]", self.text):
                if m[0] == "{":
                    waiting.append(m.start())
                elif m[0] == "}" and waiting:
                    self._braces[waiting.pop()] = m.start()
        return self._braces.get(at)


def _finds(known: _Text, begin: int, stop: int) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of what may be a construct, none inside another."""
    text = known.text
    underlined = {m.start(): m for m in _SETEXT.finditer(text, begin, stop)} if "\n===" in text or "\n---" in text else {}
    at = begin
    for place in sorted(underlined):
        for find in _between(known, at, place, stop):
            yield find
            at = max(at, find[2])
        if place >= at:
            yield "setext", place, underlined[place].end()
            at = underlined[place].end()
    yield from _between(known, at, stop, stop)


def _between(known: _Text, begin: int, until: int, stop: int) -> Iterator[tuple[str, int, int]]:
    """Finds that start in ``text[begin:until]``; they may end up to ``stop``."""
    text, done = known.text, begin
    for trigger in _TRIGGER.finditer(text, begin, stop):
        start = trigger.start()
        if start >= until:
            return
        if start < done:
            continue
        m = None
        if start == 0 or text[start - 1] == "\n":
            m = _LINE.match(text, start, stop)
        if m is None and (pair := known.closed(start, stop)) is not None:
            yield pair[0], start, pair[1]
            done = pair[1]
            continue
        m = m or _INLINE.match(text, start, stop)
        if m is not None and m.end() > start:
            yield {"f": "fence", "w": "wikiheading"}.get(m.lastgroup, m.lastgroup), start, m.end()
            done = m.end()


_ANY = re.compile(r"[<>&$\\`\[\]{}|=#*_~']|^\s*(?:[-+>]|\d{1,3}[.)])\s|^-{3,}", re.M)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
# Attribute names that are common in HTML, and special names of Python.
ATTRIBUTES = frozenset("class id style href src alt title name rel target width height lang dir type value content colspan rowspan align valign border color size face data aria role action method".split())
SPECIAL = frozenset("init main name str repr len call enter exit iter next new del doc all file dict slots version getitem setitem contains eq hash kwargs kw args opts options".split())
_NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)|\\([A-Za-z]+)|&([#\w]+);")


class Node:
    """A possible construct: ``text[start:open_end]`` opens it, ``text[close_start:end]`` closes it."""

    __slots__ = ("attribute_names", "attribute_values", "attributes", "children", "close_start", "closed", "end", "kind", "known", "name", "open_end", "parent", "start")

    def __init__(self, kind: int, start: int, end: int, name: str = "") -> None:
        self.kind, self.start, self.end, self.name = kind, start, end, name
        self.open_end = self.close_start = end
        self.closed, self.known, self.attributes, self.attribute_names, self.attribute_values = True, False, 0, 0, 0
        self.parent: Node | None = None
        self.children: list[Node] = []


_WRAPS = {"strong": 2, "strike": 2, "quoted": 2, "emphasis": 1, "code": 1}


def _scan(known: _Text, begin: int, stop: int, out: list[Node]) -> None:
    # What is inside a find is scanned after all that is beside it: places then rise within each pass.
    text, inner = known.text, []
    for group, start, end in _finds(_Text(text), begin, stop):
        found = text[start:end]
        node = Node(KIND[group], start, end)
        out.append(node)
        if (name := _NAME.match(found)) is not None and group in ("tag", "entity", "command", "environment"):
            node.name = (name[1] or name[2] or name[3]).lower()
        if group == "tag":
            node.known = node.name in HTML_NAMES
            tokens = _ATTRIBUTE.findall(found)
            node.attributes, node.attribute_names = len(tokens), sum(name.lower().partition("-")[0] in ATTRIBUTES for name, _ in tokens)
            node.attribute_values = sum(value[0] in "\"'" for _, value in tokens)
            node.closed = found.endswith("/>") or node.name in VOID
            if not found.endswith(">"):
                node.attributes -= 1
        elif group == "entity":
            node.known = node.name.startswith("#") or html.unescape(found) != found and html.unescape(found)[-1:] != ";"
        elif group == "command":
            node.known = node.name in LATEX_NAMES
            node.closed = found.endswith("{")
            if node.closed:
                node.open_end = end
                close = known.brace(end - 1)
                if close is not None and close < stop:
                    node.end, node.close_start = close + 1, close
                else:
                    node.end = node.close_start = end
        elif group == "environment":
            node.known = True
        elif group in _WRAPS or group == "wikiemphasis":
            width = _WRAPS.get(group) or (3 if found.startswith("'''") else 2)
            node.closed = len(found) > 2 * width
            node.known = found.strip("*_") in SPECIAL or not node.closed and re.match(r"\w*", text[end:])[0] in SPECIAL
            if node.closed:
                node.open_end, node.close_start = start + width, end - width
                if group != "code":
                    inner.append((node.open_end, node.close_start))
        elif group == "link" and found.startswith("[") and "](" in found:
            node.open_end, node.close_start = start + 1, start + found.index("](")
            node.closed = found.endswith(")")
            inner.append((node.open_end, node.close_start))
        elif group in ("heading", "wikiheading", "setext", "tablerow"):
            lead = len(found) - len(found.lstrip("#= \t|!"))
            if group == "setext":
                node.open_end, node.close_start = start, start + found.rindex("\n", 0, len(found))
            elif group == "wikiheading":
                node.open_end, node.close_start = start + lead, start + len(found.rstrip("= \t"))
            else:
                node.open_end, node.close_start = start + lead, end
            inner.append((node.open_end, node.close_start))
        elif group in ("template", "wikilink", "comment"):
            node.closed = found.endswith(("}}", "]]", "-->")) and len(found) > 2
    for a, b in inner:
        _scan(known, a, b, out)


def parse(text: str) -> list[Node]:
    """The nodes of a text in order of their starts, linked to parents and children."""
    nodes: list[Node] = []
    if not _ANY.search(text):
        return nodes
    _scan(_Text(text), 0, len(text), nodes)
    nodes.sort(key=lambda n: (n.start, -n.end))
    waiting: dict[str, list[Node]] = {}
    for n in nodes:
        if n.kind == KIND["tag"] and not n.closed:
            if text[n.start + 1] != "/":
                waiting.setdefault(n.name, []).append(n)
            elif waiting.get(n.name):
                opening = waiting[n.name].pop()
                opening.closed = n.closed = True
                opening.close_start, opening.end = n.start, n.end
        elif n.kind == KIND["environment"]:
            name = text[n.start : n.end].partition("{")[2].partition("}")[0]
            if n.name == "begin":
                n.closed = False
                waiting.setdefault("\\" + name, []).append(n)
            elif waiting.get("\\" + name):
                opening = waiting["\\" + name].pop()
                opening.closed, opening.close_start, opening.end = True, n.start, n.end
            else:
                n.closed = False
    stack: list[Node] = []
    for n in nodes:
        while stack and stack[-1].end <= n.start:
            stack.pop()
        if stack:
            n.parent = stack[-1]
            stack[-1].children.append(n)
        stack.append(n)
    return nodes


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Per code point: letter, digit, sign of a formula."""
    out = np.zeros((3, 0x110000), bool)
    chars = [chr(c) for c in range(0x110000)]
    out[0], out[1] = [c.isalpha() for c in chars], [c.isdigit() for c in chars]
    out[2, [ord(c) for c in "\\^_{}=+"]] = True
    return out


def features(text: str, nodes: list[Node]) -> np.ndarray:
    """A row per node: kind, closing, attribute tokens, surroundings, inside, depth, siblings, subtree density."""
    tops = [n for n in nodes if n.parent is None]
    of_kind = np.bincount([n.kind for n in nodes], minlength=len(KINDS))
    rows = np.zeros((len(nodes), len(KINDS) + 28))
    depth: dict[int, int] = {}
    below: dict[int, int] = {}
    # How many letters, digits and formula signs come before each place: a node's whole inside counts, however long.
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sums = np.zeros((3, len(codes) + 1), np.int64)
    np.cumsum(_classes()[:, codes], axis=1, out=sums[:, 1:])
    for n in reversed(nodes):
        below[id(n)] = sum(1 + below[id(c)] for c in n.children)
    for row, n in zip(rows, nodes, strict=True):
        depth[id(n)] = d = 0 if n.parent is None else depth[id(n.parent)] + 1
        siblings = n.parent.children if n.parent else tops
        before = text[n.start - 1] if n.start else "\n"
        after = text[n.end] if n.end < len(text) else "\n"
        a, b = (n.open_end, n.close_start) if n.close_start > n.open_end else (n.start, n.end)
        inside = (sums[:, b] - sums[:, a]) / max(1, b - a)
        length = max(1, n.end - n.start)
        row[n.kind] = 1
        row[len(KINDS) :] = (
            n.closed, n.known, n.attributes, n.attribute_names, n.attribute_values, before.isalnum(), before.isspace(), before in ":\\/", before in "([{<", before == "\n", after.isalnum(), after.isspace(), after in "([{<", after in "\\/.;:",
            text[a].isspace(), text[b - 1].isspace(), text[a].isalnum(), text[b - 1].isalnum(), *inside, np.log1p(length), d, np.log1p(len(siblings)), np.log1p(of_kind[n.kind]), below[id(n)] / length * 100, np.log1p(len(n.children)), n.parent.kind if n.parent else -1,
        )
    return rows


def decode(nodes: list[Node], margins: np.ndarray) -> np.ndarray:
    """Which nodes are markup: the likeliest labelling without markup inside literal markup.

    Solved from the leaves up: a literal node is markup only if that outweighs all that its subtree would
    have to give up.  Lists are structure, not markup, and keep their margin.
    """
    yes = -np.logaddexp(0, -margins)
    no = -np.logaddexp(0, margins)
    index = {id(n): i for i, n in enumerate(nodes)}
    free, plain, choice = np.zeros(len(nodes)), np.zeros(len(nodes)), np.zeros(len(nodes), bool)
    for i in range(len(nodes) - 1, -1, -1):
        children = [index[id(c)] for c in nodes[i].children]
        below_free, below_plain = free[children].sum(), plain[children].sum()
        as_markup = yes[i] + (below_plain if nodes[i].kind in LITERAL else below_free)
        as_plain = no[i] + below_free
        choice[i] = as_markup > as_plain
        free[i], plain[i] = max(as_markup, as_plain), no[i] + below_plain
    hidden = np.zeros(len(nodes), bool)
    for i, n in enumerate(nodes):
        if n.parent is not None:
            p = index[id(n.parent)]
            hidden[i] = hidden[p] or (choice[p] and n.parent.kind in LITERAL)
    return choice & ~hidden


# ---- training texts -------------------------------------------------------------------------------

_SYLLABLES = "ba ke lo mi nu ra se ti vo xa zé pri gra mon tel dur ния при für ção".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _words(r: random.Random, low: int = 1, high: int = 3) -> str:
    return " ".join(_word(r) for _ in range(r.randint(low, high)))


def _sentence(r: random.Random) -> str:
    return (_words(r, 4, 12).capitalize() + r.choice([".", ".", ",", ";", "!", "?", ":"])).replace(" ", r.choice([" ", " ", f" {r.randint(1, 999)} "]), 1)


def _construct(r: random.Random) -> tuple[str, bool]:
    """A piece of markup and whether it needs lines of its own."""
    w, ws, n = _word(r), _words(r), r.randint(1, 99)
    any_ = r.choice([ws, ws, ws, str(n), f"{ws},", f"{w} {n}"])
    tag = r.choice("b i em strong sup sub span code p div u small td li h2 h3 SPAN".split())
    attribute = r.choice([f' class="{w}"', f" CLASS={w}", f' id="{n}"', f" style='{w}: {n}px'", ""])
    inline = [
        f"<{tag}{attribute}>{any_}</{tag}>", f'<a href="https://{w}.org/{n}">{ws}</a>', "<br>", "<br/>", f"<img src='{w}.png' alt=''/>", f"<{tag}{attribute}>", f"</{tag}>", f"<!-- {ws} -->",
        r.choice(["&amp;", "&lt;", "&gt;", "&nbsp;", "&quot;", "&eacute;", "&mdash;"]), f"&#{r.randint(32, 9000)};", f"&#x{r.randint(32, 9000):x};", f'<ref name="{w}"/>', f"<ref>{ws}</ref>",
        f"**{any_}**", f"__{any_}__", f"*{any_}*", f"_{any_}_", f"~~{any_}~~", f"`{any_}`", f"`{w}_{n}`", f"[{any_}]({w}.md)", f"[{ws}](https://{w}.org/{n})", f"![{ws}](img/{n}.png)", f"[^{n}]",
        f"[[{any_}]]", f"[[{w}|{any_}]]", f"[[Category:{w}]]", f"[[File:{w}.svg|thumb|{ws}]]", f"{{{{cite {w}|title={ws}|page={n}}}}}", f"'''{any_}'''", f"''{any_}''", f"[https://{w}.org {ws}]",
        f"\\textbf{{{any_}}}", f"\\emph{{{any_}}}", f"\\cite{{{w}{n}}}", f"~\\ref{{sec:{w}}}", f"\\footnote{{{ws}}}", f"``{any_}''", f"\\label{{{w}}}", f"\\{r.choice(['textit', 'texttt', 'url', 'eqref'])}{{{w}}}",
        f"${r.choice('xyznk')}_{{{n}}}^{{2}}$", f"${w[0]} = {n}$", f"$\\alpha \\leq {n}$", f"\\(\\beta_{n} + 1\\)", f"\\[ \\frac{{a}}{{n+{n}}} \\]", f"$$ \\sum_i x_i = {n} $$",
        f"<b>{ws}", f"**{ws}", f"[{ws}]({w}", f"{{{{{w} {n}", f"<a href=\"https://{w}.org", f"\\textbf{{{ws}", f"&lt;{tag}&gt;{ws}&lt;/{tag}&gt;",
    ]
    block = [
        f"{'#' * r.randint(1, 6)} {ws}", f"{ws}\n{r.choice('=-') * r.randint(3, 12)}", f"== {ws} ==", f"=== {ws} ===", f"```\n{w} = {n}\n```", f"```{w}\n{w}({n})\n~~~ {w}\n```", f"~~~\n{ws}\n~~~", "```",
        f"| {w} | n |\n|---|---|\n| {ws} | {n} |", f'{{| class="{w}"\n|-\n! {w}\n| {n}\n|}}', f"> {ws}", f"[^{n}]: {ws}", f"\\section{{{ws}}}", f"\\begin{{itemize}}\n\\item {ws}\n\\end{{itemize}}",
        f"{{{{Infobox {w}\n| size = {n}\n}}}}", f"<ul><li>{w}</li><li>{ws}</li></ul>", f"<pre><code>if {w} &lt; {n}</code></pre>", f"<{r.choice(['div', 'p', 'h2'])}>{ws}</{r.choice(['div', 'p', 'h2'])}>", f"\\begin{{equation}}\nx_{n}\n\\end{{equation}}",
        f"<table>\n<tr><td>{ws}</td></tr>\n</table>", f"|-\n| {ws}",
    ]
    if r.random() < 0.35:
        return r.choice(block), True
    return r.choice(inline), False


def _plain(r: random.Random, sources: Sequence[str]) -> tuple[str, bool]:
    """Signs as plain text, of one of the sources."""
    own = r.random() < 0.1
    line = r.choice(PLAIN_LINES if own else PLAIN[r.choice(sources)])
    fill = {"w": lambda: _word(r) if r.random() < 0.7 else _word(r).capitalize(), "ws": lambda: _words(r), "n": lambda: str(r.randint(0, 999)), "m": lambda: str(r.randint(0, 99)), "c": lambda: r.choice("abcdefghijklmnopqrstuvwxyzABCXYZ")}
    return re.sub(r"\{(ws|w|n|m|c)\}", lambda m: fill[m[1]](), line).replace("{{", "{").replace("}}", "}"), own


def training_text(r: random.Random, sources: Sequence[str] = tuple(PLAIN)) -> tuple[str, list[tuple[int, int]]]:
    """A text with markup and plain signs of the sources, and where its markup lies."""
    out, spans, size = [], [], 0
    for _ in range(r.randint(2, 6)):
        parts: list[tuple[str, bool]] = [(_sentence(r) if r.random() < 0.5 else _words(r, 3, 9), False)]
        for _ in range(r.randint(0, 2)):
            positive = r.random() < 0.5
            piece, own = _construct(r) if positive else _plain(r, sources)
            if own:
                parts += [("\n", False), (piece, positive), ("\n", False)]
            else:
                parts += [(r.choice([" ", " ", " ", ""]) if positive else " ", False), (piece, positive), (r.choice([" ", " ", ", ", ". "]), False), (_sentence(r) if r.random() < 0.5 else _words(r, 3, 9), False)]
        for piece, positive in [*parts, (r.choice([" ", " ", "\n", "\n\n"]), False)]:
            if positive:
                spans.append((size, size + len(piece)))
            out.append(piece)
            size += len(piece)
    return "".join(out), spans


@lru_cache(maxsize=2)
def classifier(texts: int = TRAINING_TEXTS, sources: tuple[str, ...] = tuple(PLAIN)) -> BoostedTrees:
    """Trees fitted on ``texts`` written texts, always the same; plain signs come from the sources."""
    r = random.Random(5)
    rows, labels = [], []
    for _ in range(texts):
        text, spans = training_text(r, sources)
        nodes = parse(text)
        if nodes:
            rows.append(features(text, nodes))
            labels += [n.kind != KIND["list"] and any(a < n.end and n.start < b and n.start >= a - 1 for a, b in spans) for n in nodes]
    return BoostedTrees().fit(np.concatenate(rows), np.array(labels, float))


# ---- clean text -----------------------------------------------------------------------------------

_BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())


def _render(text: str, node: Node, inner: str) -> str:
    """The clean form of a markup node, given that of its inside."""
    found, kind = text[node.start : node.end], KINDS[node.kind]
    if kind in ("fence", "formula"):
        return found
    if kind == "code":
        return found if node.closed else inner
    if kind == "entity":
        return html.unescape(found).replace("\xa0", " ")
    if kind in ("comment", "image", "tablerule", "wikitable", "template"):
        alt = re.match(r"!\[([^\]\n]*)\]", found)
        return alt[1] if alt else ""
    if kind == "tag":
        name = node.name
        if name == "br" or name == "hr":
            return "\n"
        if name in ("script", "style") and node.closed:
            return ""
        if re.fullmatch("h[1-6]", name) and node.closed and found[1] != "/":
            return f"\n{'#' * int(name[1])} {inner.strip()}\n"
        if name == "li" and found[1] != "/":
            return f"\n- {inner.strip()}"
        if name == "pre" and node.closed and found[1] != "/":
            return f"\n```\n{inner.strip()}\n```\n"
        if name == "code" and node.closed and found[1] != "/" and not (node.parent and node.parent.name == "pre"):
            return f"`{inner}`"
        if name in ("td", "th"):
            return f"{inner} " if inner else " "
        return f"\n{inner}\n" if name in _BLOCKS else inner
    if kind == "environment":
        name = re.match(r"\\\w+\{(\w+)", found)
        if name and name[1] in ("equation", "align", "verbatim", "lstlisting", "math", "displaymath", "gather", "eqnarray"):
            return found if node.closed else inner
        return inner
    if kind == "command":
        name = node.name
        if name in ("section", "chapter", "part", "subsection", "subsubsection", "paragraph", "title"):
            return f"\n{'#' * {'subsection': 3, 'subsubsection': 4, 'paragraph': 5, 'section': 2}.get(name, 1)} {inner.strip()}\n"
        if name == "item":
            return "\n- "
        if name in ("cite", "citep", "citet", "label", "ref", "eqref", "pageref", "bibliography", "includegraphics", "usepackage", "documentclass"):
            return ""
        return f" ({inner})" if name == "footnote" else inner
    if kind == "wikilink":
        label = found.strip("[]")
        return "" if re.match(r"(?i)(category|file|image):", label) else label.rpartition("|")[2]
    if kind == "footnote":
        return ""
    if kind == "link" and found.startswith("[http"):
        return found.strip("[]").partition(" ")[2]
    if kind in ("heading", "wikiheading", "setext"):
        level = len(found) - len(found.lstrip("#")) if kind == "heading" else len(found) - len(found.lstrip("=")) if kind == "wikiheading" else 1 if found.rstrip().endswith("=") else 2
        return f"{'#' * min(level, 6)} {inner.strip()}"
    if kind == "tablerow":
        return re.sub(r"[ \t]*(?<!\\)\|+[ \t]*", " | ", inner).strip(" |")
    if kind == "quote":
        return ""
    return inner


def clean(text: str, nodes: list[Node], markup: np.ndarray) -> str:
    """The text with every markup node in its clean form; plain signs stay as they are."""
    chosen = {id(n) for n, yes in zip(nodes, markup, strict=True) if yes}

    def inside(children: list[Node], begin: int, stop: int) -> str:
        out, at = [], begin
        for c in children:
            if c.start < at or c.end > stop and c.start >= stop:
                continue  # a closing tag that its opening has taken, or an overlap
            out.append(text[at : c.start])
            end = min(c.end, stop)
            if id(c) not in chosen:
                out.append(inside(c.children, c.start, end))
            else:
                wrapped = c.close_start > c.open_end
                if c.kind == KIND["tag"] and c.closed and not wrapped and c.end > c.open_end:
                    body = ""
                else:
                    body = inside(c.children, c.open_end, min(c.close_start, stop)) if wrapped else ""
                out.append(shown := _render(text, c, body))
                if not shown and text[c.start - 1 : c.start] == " " == text[end : end + 1]:
                    end += 1  # one space where something between two is gone
            at = end
        out.append(text[at:stop])
        return "".join(out)

    result = inside([n for n in nodes if n.parent is None], 0, len(text))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", result)).strip("\n")


def _judged(texts: list[str | None], trees: BoostedTrees) -> list[tuple[list[Node], np.ndarray]]:
    parsed = [parse(t) if t else [] for t in texts]
    rows = [features(t, n) for t, n in zip(texts, parsed, strict=True) if n]
    margins = trees.margin(np.concatenate(rows)) if rows else np.empty(0)
    out, at = [], 0
    for nodes in parsed:
        out.append((nodes, decode(nodes, margins[at : at + len(nodes)]) if nodes else np.zeros(0, bool)))
        at += len(nodes)
    return out


def cleaned(rows: DataFrame, key: str, text: str, training_texts: int = TRAINING_TEXTS) -> DataFrame:
    """``(key, text, constructs)`` per row: clean text, and how many markup constructs were in it.

    Headings come out as ``# `` lines, list items as ``- `` lines, code in its marks and formulas as they were.
    Null texts stay null with 0 constructs, empty ones empty.  Rows are independent: nothing is shuffled.
    """
    trees = rows.sparkSession.sparkContext.broadcast(classifier(training_texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 200):
                part = batch.slice(begin, 200)
                texts = part.column(1).to_pylist()
                judged = _judged(texts, trees.value)
                found = [int(m.sum()) for _, m in judged]
                result = [t if not t else clean(t, *j) for t, j in zip(texts, judged, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(result, pa.string()), pa.array(found, pa.int32())], ["key", "text", "constructs"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(F.col(key).alias("key"), F.col(text).alias("_text")).mapInArrow(run, f"key {kind}, text string, constructs int")
