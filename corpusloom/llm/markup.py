"""Markup residue: HTML, Markdown, wiki and LaTeX signs found, and text cleaned of them, over a tree of nodes.

A text is parsed into a tree: the document, its sections (opened by headings, nested by level), their blocks (paragraph,
heading, list item, table row, code, formula), and in the blocks the signs of markup. Code (fenced, marked as code, verbatim
or indented by four spaces) is masked first: nothing in it is a sign. Every node has two states; potentials connect parent
and child, sum-product messages go up from the leaves and down from the root, all nodes of a depth at once.

What a document holds (markup_kinds) is decided on one such tree for every kind of markup: the state of the document, a
section and a block is whether it is written in that kind, that of a sign whether it is meant as markup or in its plain
sense. A sign's unary potential is that of its type: the strict forms that a kind defines, and looser ones (a star, a brace,
a backslash alone). All potentials, unary and pairwise, are estimated by expectation-maximisation on at most TRAINING pages
in which the strict forms are labelled as meant and the loose ones are not labelled (no table labels markup). A kind is held if the
marginal of any of its signs says that it is meant.

What is content (cleaned) is decided on the same tree: whether a block is content or a leftover of the page (navigation,
provenance). Unary and pairwise potentials are estimated from at most TRAINING pages labelled by the kind of their chunks.
Clean text keeps headings (as #), list items (as -), table rows, code (fenced) and formulas, and drops signs and leftovers.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

TRAINING = 600  # labelled pages the content potentials are estimated on, at most
KINDS = ("html", "markdown", "wiki", "latex")
ROUNDS = 6  # of expectation-maximisation

# Element names of HTML
ELEMENTS = (
    "a abbr address article aside audio b big blockquote body br button canvas caption center cite code col colgroup dd del details dfn div dl dt em embed "
    "fieldset figcaption figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark "
    "menu meta nav nobr noscript object ol optgroup option p param picture pre q s samp script section select small source span strike strong style sub "
    "summary sup table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()

#: Code, whichever starts first: fenced, verbatim, marked, indented, in back quotes
_CODE = re.compile(
    r"^(?P<fence> {0,3}(?P<f>`{3,}|~{3,})[^\n]*(?:\n(?:.*\n)*?(?: {0,3}(?P=f)[`~]*[ \t]*$)|(?:\n.*)*\Z))"
    r"|(?P<verbatim>\\begin\{(?P<v>verbatim\*?|lstlisting|minted)\}[\s\S]*?\\end\{(?P=v)\}|\\verb\*?(?P<d>[^\w\s*])[^\n]*?(?P=d))"
    r"|(?P<pre><(?P<p>pre|code|script|style|samp|kbd|tt)\b[^<>]*>[\s\S]*?</(?P=p)\s*>)"
    r"|(?P<plain><(?P<n>syntaxhighlight|source|nowiki|math)\b[^<>]*>[\s\S]*?</(?P=n)\s*>)"
    r"|^(?P<indented> {4,}\S.*)$"
    r"|(?<![`\\])(?P<span>(?P<q>`{1,2})(?!`)[^`\n]*[^`\s][^`\n]*(?P=q)(?!`))",
    re.M | re.I,
)
_OF = {"fence": "markdown", "verbatim": "latex", "pre": "html", "span": "markdown"}

_TAG = r"<(/?)(?:" + "|".join(ELEMENTS) + r")(?:\s+[a-zA-Z_:@][^<>]*|\s*)/?>"
#: Signs: kind, what must stand in a text for the pattern to be tried, pattern
SIGNS = (
    ("html", ("<",), re.compile(_TAG, re.I)),
    ("html", ("<!",), re.compile(r"<!--.*?-->|<!DOCTYPE\s[^>]*>", re.S | re.I)),
    ("html", ("&",), re.compile(r"&(?:[a-zA-Z][a-zA-Z0-9]{1,9}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});")),
    ("markdown", ("#",), re.compile(r"^ {0,3}#{1,6}[ \t]+\S[^\n]*$", re.M)),
    ("markdown", ("\n---", "\n===", "\n --", "\n =="), re.compile(r"(?:^|\n[ \t]*\n|\A)(?! {0,3}(?:[-*+|>#=]|\d+[.)])\s?)[^\n|]*\S[^\n]*\n {0,3}(?:={3,}|-{3,})[ \t]*(?=\n|\Z)")),
    ("markdown", ("**", "__"), re.compile(r"(?<![\w*\\])\*\*(?![\s*])[^*\n]*[^\s*]\*\*(?![\w*])|(?<![\w\\])__(?![\s_])(?:[^_\n]|_(?!_))*[^\s_]__(?!\w)")),
    ("markdown", ("*", "_"), re.compile(r"(?<![\w*\\/])\*(?![\s*])[^*\n]*[^\s*]\*(?![\w*/])|(?<![\w\\/])_(?![\s_])(?:[^_\n]|(?<=\w)_(?=\w))*[^\s_]_(?![\w/])")),
    ("markdown", ("]", "<http"), re.compile(r"!?\[[^\[\]\n]+\]\((?:<?(?:https?:|mailto:|ftp:|\.{0,2}/|#)[^()\s]*(?:\([^()\s]*\))?[^()\s]*>?|[\w./-]+\.\w+)(?:\s+\"[^\"\n]*\")?\)|^ {0,3}\[[^\]\n]+\]:\s+\S+|<https?://[^<>\s]+>", re.M)),
    ("markdown", ("-|", "|-", "| -", "- |", "|:", ":|"), re.compile(r"^ {0,3}\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^ {0,3}\|[ \t]*:?-{2,}:?[ \t]*\|[ \t]*$", re.M)),
    ("wiki", ("=",), re.compile(r"^(={1,6})[ \t]*[^=\s](?:[^\n]*[^=\s])?[ \t]*\1[ \t]*$", re.M)),
    ("wiki", ("''",), re.compile(r"(?<!')'''?(?![\s'])[^'\n](?:[^\n]*?[^\s'])?'''?(?!')")),
    ("wiki", ("[[", "[http", "[//"), re.compile(r"\[\[[^\W\d_:#][^\[\]\n]*\]\]|\[\[[:#][^\[\]\n]+\]\]|\[(?:https?:)?//[^\s\[\]]+(?: [^\[\]\n]*)?\](?!\()")),
    ("wiki", ("{{",), re.compile(r"\{\{[^\W\d_][^{}\n]*(?:\{\{[^{}]*\}\}[^{}\n]*)*\}\}|\{\{#[^{}]*\}\}")),
    ("wiki", ("{|", "|}"), re.compile(r"^\{\|.*$|^\|\}[ \t]*$", re.M)),
    ("latex", ("\\",), re.compile(r"\\(?:begin|end)\{[a-zA-Z*]+\}")),
    ("latex", ("\\",), re.compile(r"(?<![\\:])\\[a-zA-Z]{2,}\*?[ \t]*(?:\[[^\[\]\n]*\])?\{|(?<![\w\\:/.])\\[a-zA-Z]{2,}(?![a-zA-Z\\:/])")),
)
_NUMBERED = re.compile(r"(?:^ {0,3}#{1,6}[ \t]+\S[^\n]*\n){1,}^ {0,3}#{1,6}[ \t]+\S[^\n]*$", re.M)


#: Looser forms that may be meant as signs or in their plain sense: kind, what must stand in a text, pattern
LOOSE = (
    ("html", ("<",), re.compile(r"<[a-zA-Z/!][^<>\n]{0,80}>?")),
    ("html", ("&",), re.compile(r"&\w*")),
    ("markdown", ("*", "_"), re.compile(r"(?<!\w)[*_]+(?=\S)|(?<=\S)[*_]+(?!\w)")),
    ("markdown", ("#", "["), re.compile(r"^ {0,3}#+|\[[^\[\]\n]*\]", re.M)),
    ("markdown", ("|", "`"), re.compile(r"[|`]+")),
    ("wiki", ("=", "''"), re.compile(r"={2,}|''+")),
    ("wiki", ("[", "{"), re.compile(r"\[+[^\[\]\n]*\]+|\{+[^{}\n]*\}+")),
    ("latex", ("\\",), re.compile(r"\\[a-zA-Z]+")),
    ("latex", ("$",), re.compile(r"\$+")),
)
#: Kind of every type of sign: strict forms, marks of code, loose forms
TYPES = np.array([KINDS.index(k) for k in [*(x[0] for x in SIGNS), *KINDS, *(x[0] for x in LOOSE)]])
STRICT = np.arange(len(TYPES)) < len(SIGNS) + len(KINDS)


def masked(text: str) -> tuple[str, list[tuple[str, int]]]:
    """The text with code blanked out (line breaks stay), and (kind, place) of the code marks that are signs of markup themselves."""
    own: list[tuple[str, int]] = []

    def run(m):
        name = next(n for n in ("fence", "verbatim", "pre", "plain", "indented", "span") if m[n] is not None)
        if name in _OF:
            own.append((_OF[name], m.start()))
        return re.sub(r"[^\n]", "\x00", m[0])

    return (_CODE.sub(run, text) if any(x in text for x in ("`", "~~~", "\\verb", "\\begin{", "</", "    ")) else text), own


def _list_like(text: str) -> str:
    """Runs of lines that all start with the same number signs are lists, not headings; the length stays."""
    return _NUMBERED.sub(lambda m: re.sub(r"^( {0,3})(#+)", lambda x: x[1] + "-" * len(x[2]), m[0], flags=re.M) if len({x.split()[0] for x in m[0].split("\n")}) == 1 else m[0], text)


def signs_of(text: str) -> tuple[str, list[tuple[int, int]]]:
    """(text without code, [(type, place)]) of all signs, strict ones first; a loose form within a strict one of its kind is none."""
    bare, own = masked(text)
    if "#" in bare:
        bare = _list_like(bare)
    out = [(len(SIGNS) + KINDS.index(k), at) for k, at in own]
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for i, (kind, gate, pattern) in enumerate(SIGNS):
        if any(g in bare for g in gate):
            for m in pattern.finditer(bare):
                out.append((i, m.start()))
                spans[kind].append(m.span())
    starts = {k: sorted(v) for k, v in spans.items()}
    for i, (kind, gate, pattern) in enumerate(LOOSE, len(SIGNS) + len(KINDS)):
        if any(g in bare for g in gate):
            held = starts[kind]
            for m in pattern.finditer(bare):
                at = bisect.bisect_right(held, (m.start(), len(bare)))
                if not any(z > m.start() for _, z in held[max(0, at - 3) : at]):
                    out.append((i, m.start()))
    return bare, out


_ANY_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]|^(={1,6})[^=\n]|^\\((?:sub)*)section\b|^[ \t]*<h([1-6])\b", re.M | re.I)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


class Forest:
    """Trees of two-state nodes, all in one set of arrays; a node comes after its parent, a root has parent -1."""

    def __init__(self, parent: list[int], edge: list[int], kind: list[int], count: list[int]):
        self.parent, self.edge, self.kind = np.array(parent, np.int64), np.array(edge, np.int64), np.array(kind, np.int64)
        self.count = np.array(count, float)  # how many equal leaves a node stands for
        depth = np.zeros(len(parent), np.int64)
        for i, p in enumerate(parent):
            if p >= 0:
                depth[i] = depth[p] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=-1)) + 1)]

    def run(self, prior: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log beliefs [n, 2], expected pair states [n, 2, 2]) by sum-product; prior: log unary [n, 2], pair: log potentials [edges, parent, child]."""
        up, message = prior.astype(float).copy(), np.zeros((len(prior), 2))
        for level in self.levels[:0:-1]:  # leaves to root
            message[level] = np.logaddexp(pair[self.edge[level], :, 0] + up[level, 0:1], pair[self.edge[level], :, 1] + up[level, 1:2])
            np.add.at(up, self.parent[level], message[level] * self.count[level, None])
        belief, both = up.copy(), np.zeros((len(prior), 2, 2))
        for d, level in enumerate(self.levels):  # root to leaves
            if d:
                rest = belief[self.parent[level]] - message[level]
                joint = rest[:, :, None] + pair[self.edge[level]] + up[level][:, None, :]
                joint -= np.logaddexp(np.logaddexp(joint[:, 0, 0], joint[:, 0, 1]), np.logaddexp(joint[:, 1, 0], joint[:, 1, 1]))[:, None, None]
                both[level] = np.exp(joint)
                belief[level] = np.logaddexp(joint[:, 0], joint[:, 1])
            else:
                belief[level] -= np.logaddexp(belief[level, 0], belief[level, 1])[:, None]
        return belief, both


def two_state_marginals(prior: np.ndarray, pair: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """P(state 1) of every node of a tree; prior: log potentials [n, 2], pair: [n, 2, 2] between the parent's and a node's state."""
    n = len(prior)
    return np.exp(Forest(list(parent), list(range(n)), [0] * n, [1] * n).run(prior, pair)[0][:, 1])


def nested(levels: list[int], parent_of_all: int, first: int) -> list[int]:
    """Parents of sections by heading level: the last one before with a smaller level, else the document; sections are numbered from `first`."""
    out, stack = [], []
    for i, level in enumerate(levels):
        while stack and stack[-1][0] >= level:
            stack.pop()
        out.append(stack[-1][1] if stack else parent_of_all)
        stack.append((level, first + i))
    return out


DOC_SECTION, SECTION_SECTION, TO_BLOCK, TO_SIGN = range(4)


def kind_forest(texts: list[str]) -> tuple[Forest, np.ndarray, np.ndarray]:
    """(forest, type, text): a tree for every text and kind of which it has a sign, strict or loose; type is -1 but for signs."""
    parent, edge, kind, count, type_, text_ = [], [], [], [], [], []

    def node(p: int, e: int, k: int, t: int, n: int, c: int = 1) -> int:
        parent.append(p)
        edge.append(e)
        kind.append(k)
        count.append(c)
        type_.append(t)
        text_.append(n)
        return len(parent) - 1

    for n, text in enumerate(texts):
        if not text:
            continue
        bare, signs = signs_of(text)
        if not signs:
            continue
        heads = [(m.start(), len(m[1] or m[2] or "") or (len(m[3]) // 3 + 1 if m[3] is not None else int(m[4]))) for m in _ANY_HEADING.finditer(bare)]
        breaks = [m.start() for m in _PARAGRAPH.finditer(bare)]
        places = [h[0] for h in heads]
        over = nested([h[1] for h in heads], -1, 0)
        by_kind: dict[int, dict[tuple[int, int], dict[int, int]]] = {}
        for t, at in signs:
            where = (bisect.bisect_right(places, at) - 1, bisect.bisect_right(breaks, at))
            types = by_kind.setdefault(int(TYPES[t]), {}).setdefault(where, {})
            types[t] = types.get(t, 0) + 1
        for k, blocks in by_kind.items():
            root = node(-1, 0, k, -1, n)
            at_section: dict[int, int] = {-1: root}

            def section(i: int) -> int:
                if i not in at_section:
                    above = section(over[i])
                    at_section[i] = node(above, DOC_SECTION if above == root else SECTION_SECTION, k, -1, n)
                return at_section[i]

            for (s, _), types in sorted(blocks.items()):
                block = node(section(s), TO_BLOCK, k, -1, n)
                for t, c in types.items():
                    node(block, TO_SIGN, k, t, n, c)
    return Forest(parent, edge, kind, count), np.array(type_, np.int64), np.array(text_, np.int64)


class KindModel:
    """Log potentials: root [kinds, 2], pair [edges, 2, 2], and of a sign's type given its state [types, 2]."""

    def __init__(self, root: np.ndarray, pair: np.ndarray, emit: np.ndarray):
        self.root, self.pair, self.emit = root, pair, emit

    @classmethod
    def initial(cls) -> KindModel:
        agree = np.log([[0.9, 0.1], [0.1, 0.9]])
        emit = np.where(STRICT[:, None], [[0.002, 1.0]], [[1.0, 0.01]])
        return cls(np.log(np.full((len(KINDS), 2), 0.5)), np.stack([agree, agree, agree, np.log([[0.9, 0.1], [0.1, 0.9]])]), cls._shares(emit))

    @staticmethod
    def _shares(n: np.ndarray) -> np.ndarray:
        """Log shares of types within a kind and state."""
        return np.log(n / np.stack([n[TYPES == k].sum(0) for k in range(len(KINDS))])[TYPES])

    @classmethod
    def trained(cls, texts: list[str]) -> KindModel:
        """By expectation-maximisation, strict signs being labels (meant) and the others free, from the initial potentials, which
        stay in it as a prior of as much weight as the pages: without it, signs of a block would be taken to be all alike,
        though meant and plain ones do stand side by side."""
        start = model = cls.initial()
        forest, type_, _ = kind_forest(texts)
        if not len(type_):
            return model
        sign, root = np.flatnonzero(type_ >= 0), np.flatnonzero(forest.parent < 0)
        for _ in range(ROUNDS):
            prior = model._prior(forest, type_)
            prior[sign[STRICT[type_[sign]]], 0] = -50.0
            belief, both = forest.run(prior, model.pair)
            p = np.exp(belief)
            emit = np.zeros((len(TYPES), 2))
            np.add.at(emit, type_[sign], p[sign] * forest.count[sign, None])
            emit += np.exp(start.emit) * np.stack([emit[TYPES == k].sum(0) + 1 for k in range(len(KINDS))])[TYPES]
            roots = np.ones((len(KINDS), 2))
            np.add.at(roots, forest.kind[root], p[root])
            pairs = np.zeros((4, 2, 2))
            inner = np.flatnonzero(forest.parent >= 0)
            np.add.at(pairs, forest.edge[inner], both[inner] * forest.count[inner, None, None])
            pairs += np.exp(start.pair) * (pairs.sum(2, keepdims=True) + 1)
            model = cls(np.log(roots / roots.sum(1, keepdims=True)), np.log(pairs / pairs.sum(2, keepdims=True)), cls._shares(emit))
        return model

    def _prior(self, forest: Forest, type_: np.ndarray) -> np.ndarray:
        prior = np.where((type_ >= 0)[:, None], self.emit[type_], 0.0)
        roots = forest.parent < 0
        prior[roots] = self.root[forest.kind[roots]]
        return prior

    def marginals(self, texts: list[str]) -> np.ndarray:
        """[texts, kinds]: the highest marginal of a sign being meant; 0 for a kind without signs."""
        out = np.zeros((len(texts), len(KINDS)))
        forest, type_, text = kind_forest(texts)
        if len(type_):
            p = np.exp(forest.run(self._prior(forest, type_), self.pair)[0][:, 1])
            sign = np.flatnonzero(type_ >= 0)
            np.maximum.at(out, (text[sign], forest.kind[sign]), p[sign])
        return out


def _some(docs: DataFrame, key: str, text: str) -> DataFrame:
    """About TRAINING rows with a text, drawn by a hash of the key; at most twice as many."""
    n = docs.count()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null").where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(min(1_000_000, 1 + 1_000_000 * TRAINING / max(1, n)))).limit(2 * TRAINING)


def trained_kinds(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> KindModel:
    """The potentials of kinds from about TRAINING documents."""
    return KindModel.trained([r["text"] for r in _some(docs, id_col, text).orderBy("key", "text").collect()])


def markup_kinds(docs: DataFrame, model: KindModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, markup, probability): one row for each kind of markup a text holds, with the highest marginal of its signs; null or blank texts hold none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = model.marginals(b["t"].tolist())
            i, k = np.nonzero(p > 0.5)
            yield pd.DataFrame({"i": b["i"].to_numpy()[i], "markup": np.array(KINDS, object)[k], "probability": p[i, k]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    return rows.mapInPandas(run, f"i {kind}, markup string, probability double").withColumnRenamed("i", id_col)


# ---- clean text -----------------------------------------------------------------------------------------------------

_HEADING = re.compile(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t#]*$|^(={1,6})[ \t]*([^=].*?)[ \t]*\3[ \t]*$|^\\((?:sub)*)section\*?\{(.*)\}[ \t]*$|^[ \t]*<h([1-6])\b[^>]*>(.*?)</h\7>[ \t]*$", re.I)
_ITEM = re.compile(r"^[ \t]*(?:[-*+•·]|\d+[.)]|\([a-z]\)|\\item|<(?:ul|ol)[^>]*><li[^>]*>|<li[^>]*>)[ \t]*(.*)$", re.I)
_ROW = re.compile(r"^[ \t]*(?:\||<tr|<td|<th|!)", re.I)
_RULE = re.compile(r"^[ \t]*(?:[-=_*]{3,}|\|?[-:| \t]+\|?|\{\|.*|\|\}|\|-[^|]*|\\(?:begin|end)\{[^}]*\})[ \t]*$")
_META = re.compile(r"^\s*(?:source|publisher|license|retrieved|title|author|date)\s*[:：]", re.I)
_VERBATIM = re.compile(r"\\begin\{(?:(verbatim\*?)\}|(lstlisting|minted)\}(?:\[[^\]\n]*\])?(?:(?<=minted\})\{\w*\}|(?<=\])\{\w*\})?)")
_FORMULAS = r"(?:equation|align|alignat|gather|multline|eqnarray|displaymath|math|[bpvBV]?matrix|cases|array|aligned|split)\*?"
_TABLES = r"tabular[xy]?\*?|longtable|tabulary"
#: Where a line of LaTeX is cut: environments and list items, not within code spans and formulas
_CUT = re.compile(
    r"(?P<kept>(?P<q>`+)[^`\n]+(?P=q)|\$[^$\n]*\\[^$\n]*\$|\\verb\*?(?P<d>[^\w\s*])[^\n]*?(?P=d))|(?P<item>\\item(?![a-zA-Z]))"
    rf"|\\begin\{{(?:(?P<formula>{_FORMULAS})|(?P<table>{_TABLES}))\}}|\\(?:begin|end)\{{(?P<name>[a-zA-Z]+\*?)\}}"
)
#: What follows \\begin{..} and is no content: options of lists and floats, columns (and width) of tables
_OPTIONS = re.compile(r"\[[^\]\n]*\]")
_COLUMNS = re.compile(r"(?:\[[^\]\n]*\]|\{(?:[^{}\n]|\{[^{}\n]*\})*\}){0,3}")
_LINES = re.compile(r"\\(?:hline|toprule|midrule|bottomrule|endhead|endfirsthead|endfoot|endlastfoot)(?![a-zA-Z])|\\(?:cline|cmidrule(?:\([lr]+\))?)\{[^{}]*\}")
_OPEN = "\n"  # the end of a table that is never closed: the next blank line
_PRE = re.compile(r"</?(?:pre|code)\b[^>]*>")
_BLOCK_TAGS = r"(?:p|div|li|tr|h[1-6]|table|ul|ol|dl|dt|dd|section|article|blockquote|header|footer|nav|main|thead|tbody)"
#: Where a line of HTML is cut: before and after elements that stand for themselves
_PARTS = re.compile(rf"(?=<{_BLOCK_TAGS}\b)|(?<=</p>)|(?<=</div>)|(?<=</li>)|(?<=</tr>)|(?<=</h[1-6]>)|(?<=</ul>)|(?<=</ol>)|(?<=</table>)|(?<=<br>)|(?<=<br/>)|(?<=<br />)", re.I)
FEATURES = 13


def blocks_of(text: str) -> list[tuple[str, str]]:
    """(type, line) of every line, code kept apart: heading, item, row, code, rule, formula, text, blank."""
    return [(kind, line) for _, kind, line in numbered_blocks(text)]


def _cut(line: str) -> re.Match | None:
    """The first sign of LaTeX in the line that what follows, or what precedes, must be cut off at."""
    if not any(x in line for x in ("\\begin{", "\\end{", "\\item")):
        return None
    return next((m for m in _CUT.finditer(line) if m["kept"] is None and (m["item"] is None or line[: m.start()].strip())), None)


def numbered_blocks(text: str) -> list[tuple[int, str, str]]:
    """Blocks with the line, from 0, that they stand on; where code, an environment or an item starts or ends within a line, the rest of it is a block of its own.

    Lines may end in \\r\\n or \\r; the blocks are without them.
    """
    out, fence, verbatim, formula, table, before = [], "", None, "", "", ""
    rest = deque(enumerate(re.sub(r"\r\n?", "\n", text).split("\n")))
    while rest:
        at, line = rest.popleft()
        s = line.strip()
        if fence:
            kind = "code"
            if s.startswith(fence):
                fence = ""
                kind = "fence"
        elif verbatim:
            kind = "code"
            if m := verbatim.search(line):
                head, tail = line[: m.start()].rstrip(), line[m.end() :]
                if _PRE.sub("", head).strip():
                    out.append((at, "code", head))
                if tail.strip():
                    rest.appendleft((at, tail.lstrip()))
                verbatim, kind, line = None, "rule", m[0]
        elif formula:
            kind = "formula" if s else "blank"
            head, end, tail = line.partition(formula)
            if end:
                formula, line = "", head + end
                if tail.strip():
                    rest.appendleft((at, tail.lstrip()))
        elif table and (s or table != _OPEN):
            head, end, tail = line.partition(table)
            rows = [re.sub(r"[ \t]*(?<!\\)&(?!#?\w+;)[ \t]*", " & ", _LINES.sub("", x)).strip() for x in re.split(r"\\\\(?:\[[^\]\n]*\])?|\\tabularnewline(?![a-zA-Z])", head)]
            out += [(at, "row", x) for x in rows if x]
            if end:
                table = ""
                if tail.strip():
                    rest.appendleft((at, tail.lstrip()))
            kind, line = "rule" if s else "blank", end
        elif "<!--" in line and "`" not in line and "-->" not in line[line.index("<!--") :]:
            # a comment over several lines
            head, over = line[: line.index("<!--")].rstrip(), ""
            while rest and "-->" not in over:
                over = rest.popleft()[1]
            tail = over.partition("-->")[2] if "-->" in over else ""
            rest.extendleft((at, x) for x in (tail.strip(), head) if x)
            continue
        elif s[:3] in ("```", "~~~"):
            fence, kind = s[:3], "fence"
        elif m := _VERBATIM.match(s):
            if s[m.end() :]:
                rest.appendleft((at, s[m.end() :].removeprefix(" ")))
            verbatim, kind, line = re.compile(re.escape("\\end{" + (m[1] or m[2]) + "}")), "rule", m[0]
        elif re.match(r"<pre\b", s, re.I) and "</pre" not in s.lower():
            verbatim, kind = re.compile(r"</pre\s*>?", re.I), "code"
        elif not s:
            kind, table = "blank", ""
        elif line.startswith("    "):
            kind = "code"
        elif "<" in line and "`" not in line and len(parts := [x for x in _PARTS.split(line) if x.strip()]) > 1:
            rest.extendleft((at, x) for x in reversed(parts))
            continue
        elif "<" in line and not re.sub(_TAG, "", line, flags=re.I).strip():
            kind = "rule"
        elif m := _cut(line):
            if line[: m.start()].strip():
                rest.extendleft([(at, line[m.start() :]), (at, line[: m.start()].rstrip())])
                continue
            end, tail = "\\end" + m[0].removeprefix("\\begin"), line[m.end() :]
            if m["formula"]:
                formula = end
                rest.appendleft((at, line))
                if not any(end in x for _, x in rest):
                    formula, kind = "", "formula"
                    rest.popleft()
                else:
                    continue
            else:
                kind, line = "rule", m[0]
                if m["table"]:
                    tail = tail[_COLUMNS.match(tail).end() :]
                    table = end if end in tail or any(end in x for _, x in rest) else _OPEN
                elif line.startswith("\\begin") and (x := _OPTIONS.match(tail)) and re.fullmatch(r"itemize|enumerate|description|figure|table", m["name"].rstrip("*")):
                    tail = tail[x.end() :]
                if tail.strip():
                    rest.appendleft((at, tail.lstrip()))
        elif _HEADING.match(line):
            kind = "heading"
        elif re.fullmatch(r"={3,}|-{3,}", s) and before == "text":
            out[-1] = (out[-1][0], "heading", out[-1][2])
            kind = "rule"
        elif _RULE.match(line):
            kind = "rule"
        elif _ITEM.match(line):
            kind = "item"
        elif _ROW.match(line):
            kind = "row"
        elif s.startswith("$") and s.endswith("$") and len(s) > 2:
            kind = "formula"
        else:
            kind = "text"
        out.append((at, kind, line))
        before = kind
    return out


def _features(kind: str, line: str, at: float, alone: bool) -> np.ndarray:
    bare = re.sub(r"<[^>]*>", "", line).strip()
    n = len(bare)
    return np.array(
        [
            bool(_META.match(bare)), kind == "heading", kind in ("code", "formula", "row"), kind == "item", n < 40, n > 120,
            bare[-1:] in ".。!?！？:", bool(re.search(r"https?://|©|»|>", bare)), at < 0.1, at > 0.9,
            alone, bool(re.search(r"\d|[:：—]", bare)), alone and n < 80 and not re.search(r"\d|[:：—»>©]", bare),
        ],
        float,
    )


def _alone(blocks: list[tuple[str, str]], i: int) -> bool:
    """Whether a line stands between blank lines, as titles do."""
    return (i == 0 or blocks[i - 1][0] in ("blank", "rule")) and (i + 1 == len(blocks) or blocks[i + 1][0] in ("blank", "rule"))


def _tree(blocks: list[tuple[str, str]]) -> tuple[list[int], list[int], list[int]]:
    """(parents, edges, where): the tree document > nested sections > lines, and the node of every line."""
    levels = [1 if not (m := _HEADING.match(line)) else len(m[1] or m[3] or "") or (len(m[5] or "") // 3 + 1 if m[6] else int(m[7] or 1)) for kind, line in blocks if kind == "heading"]
    over = nested(levels, 0, 1)
    parent, edge = [-1, *over], [0, *(DOC_SECTION if p == 0 else SECTION_SECTION for p in over)]
    section, where = 0, []
    for kind, _ in blocks:
        section += kind == "heading"
        where.append(len(parent))
        parent.append(section)
        edge.append(TO_BLOCK)
    return parent, edge, where


class ContentModel:
    """Log odds of block features, and log potentials between document, sections and blocks [edges, parent, child]."""

    def __init__(self, on: np.ndarray, off: np.ndarray, root: np.ndarray, pair: np.ndarray):
        self.on, self.off, self.root, self.pair = on, off, root, pair

    @classmethod
    def trained(cls, pages: list[tuple[str, list[tuple[int, int, bool]]]]) -> ContentModel:
        """From (text, [(first line, last line, is body)]) of labelled pages; without any, potentials are neutral towards content.

        A section or document counts as what most of its labelled blocks are.
        """
        seen, body = np.ones((2, FEATURES)), np.full(2, 2.0)
        pairs, roots = np.ones((3, 2, 2)) + np.eye(2), np.array([1.0, 2.0])
        for text, spans in pages:
            lines = numbered_blocks(text)
            label = [None] * (lines[-1][0] + 1)
            for a, z, is_body in spans:
                for i in range(max(1, a) - 1, min(z, len(label))):
                    label[i] = is_body
            blocks = [(k, x) for _, k, x in lines]
            parent, edge, where = _tree(blocks)
            votes = np.zeros((len(parent), 2))
            own = np.full(len(parent), -1)
            for i, (at, kind, line) in enumerate(lines):
                if label[at] is None or kind in ("blank", "rule", "fence"):
                    continue
                c = int(label[at])
                seen[c] += _features(kind, line, i / len(lines), _alone(blocks, i))
                body[c] += 1
                own[where[i]] = c
                n = parent[where[i]]
                while n >= 0:
                    votes[n, c] += 1
                    n = parent[n]
            held = votes.sum(1) > 0
            own[held] = votes[held].argmax(1)
            for n in range(1, len(parent)):
                if own[n] >= 0:
                    pairs[edge[n], own[parent[n]], own[n]] += 1
            if own[0] >= 0:
                roots[own[0]] += 1
        if not pages:
            return cls(np.zeros(FEATURES), np.zeros(FEATURES), np.array([-3.0, 0.0]), np.log([[[0.6, 0.4], [0.1, 0.9]]] * 3))
        p = np.clip(seen / (body[:, None] + 1), 1e-3, 1 - 1e-3)
        return cls(np.log(p[1] / p[0]), np.log((1 - p[1]) / (1 - p[0])), np.log(roots / roots.sum()), np.log(pairs / pairs.sum(2, keepdims=True)))

    def marginals(self, blocks: list[tuple[str, str]]) -> np.ndarray:
        """P(content) of every line's block in the tree document > sections > block; blank lines and rules carry no evidence."""
        if not blocks:
            return np.zeros(0)
        parent, edge, where = _tree(blocks)
        prior = np.zeros((len(parent), 2))
        prior[0] = self.root
        for i, (kind, line) in enumerate(blocks):
            if kind not in ("blank", "rule", "fence"):
                x = _features(kind, line, i / len(blocks), _alone(blocks, i))
                prior[where[i], 1] = float(x @ self.on + (1 - x) @ self.off)
        forest = Forest(parent, edge, [0] * len(parent), [1] * len(parent))
        return np.exp(forest.run(prior, self.pair)[0][where, 1])


def _inline(s: str) -> str:
    """A line's text without inline signs; code spans and formulas stay as they are."""
    kept: list[str] = []

    def keep(m):
        kept.append(m[0])
        return f"\x01{len(kept) - 1}\x02"

    s = re.sub(r"(`+)[^`\n]+\1|\$[^$\n]*\\[^$\n]*\$|\\begin\{equation\*?\}.*?\\end\{equation\*?\}", keep, s)
    s = re.sub(r"<!--.*?-->", "", s)
    s = re.sub(_TAG, "", s, flags=re.I)
    s = re.sub(r"!?\[([^\[\]\n]+)\]\((?:https?:|mailto:|\.{0,2}/|#)[^()\s]*\)", r"\1", s)
    s = re.sub(r"\[\[(?:File|Category|Image):[^\[\]]*\]\]", "", s, flags=re.I)
    s = re.sub(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]+)\]\]", r"\1", s)
    s = re.sub(r"\[https?://[^\s\[\]]+ ([^\[\]\n]*)\]", r"\1", s)
    s = re.sub(r"\{\{[^\W\d_][^{}|\n]*\|([^{}\n]*)\}\}", r"\1", s)
    s = re.sub(r"\{\{[^\W\d_][^{}\n]*\}\}", "", s)
    s = re.sub(r"'''?([^'\n]+)'''?", r"\1", s)
    s = re.sub(r"(?<![\w*])\*\*(?![\s*])([^*\n]*[^\s*])\*\*(?![\w*])|(?<!\w)__(?![\s_])([^_\n]*[^\s_])__(?!\w)", lambda m: m[1] or m[2], s)
    s = re.sub(r"(?<![\w*])\*(?![\s*])([^*\n]*[^\s*])\*(?![\w*])|(?<!\w)_(?![\s_])([^_\n]*[^\s_])_(?!\w)", lambda m: m[1] or m[2], s)
    s = re.sub(r"~?\\(?:cite|ref|label)\{[^{}]*\}", "", s)
    for _ in range(2):
        s = re.sub(r"(?<![\\:\w])\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}", r"\1", s)
    s = re.sub(r"(?<![\w\\:])\\(?:noindent|item|quad|par|centering|maketitle)\b ?", "", s)
    s = html.unescape(s).replace("\xa0", " ")
    return re.sub(r"\x01(\d+)\x02", lambda m: kept[int(m[1])], s)


def clean(text: str | None, model: ContentModel, least: float = 0.5) -> str | None:
    """Clean text: markup gone; headings, list items, table rows, code and formulas kept; of plain text, blocks below `least` content dropped,
    but for a first line that looks like a title.

    Code that its marks set apart stands between fences, with its language where the mark names one; indented code stays indented.
    """
    if text is None:
        return None
    blocks = blocks_of(text)
    p = model.marginals(blocks)
    out: list[str] = []
    inside = False  # a fence that was opened here, for code without fences of its own
    fenced = False
    title = next((i for i, (k, _) in enumerate(blocks) if k not in ("blank", "rule")), None)
    if title is not None and not (blocks[title][0] == "text" and _alone(blocks, title) and _features(*blocks[title], 0.0, True)[-1]):
        title = None  # only what looks like one is kept as the title of the text
    for i, ((kind, line), q) in enumerate(zip(blocks, p)):
        if kind == "fence":
            fenced = not fenced
            out.append("```" + (line.strip().lstrip("`~ ").split() or [""])[0] if fenced else "```")
            continue
        if inside and kind != "code" and not (kind == "blank"):
            inside = False
            while out and not out[-1]:
                out.pop()
            out.append("```")
        if kind == "blank":
            out.append("")
        elif kind == "code":
            bare = _PRE.sub("", line)
            if not fenced and not inside and not line.startswith("    "):
                if not bare.strip():
                    continue
                out.append("```")
                inside = True
            out.append(html.unescape(bare) if "<pre" in line.lower() or inside and "&" in bare and "<pre" in text.lower() else bare)
        elif kind == "rule" or (kind == "text" and q < least and i != title):
            continue
        elif kind == "heading":
            m = _HEADING.match(line)
            title = next((x for x in (m[2], m[4], m[6], m[8]) if x), "") if m else line
            level = 1 if not m else len(m[1] or m[3] or "") or (len(m[5] or "") // 3 + 1 if m[6] else int(m[7] or 1))
            out.append("#" * level + " " + _inline(title).strip())
        elif kind == "item":
            m = _ITEM.match(line)
            out.append("- " + _inline(m[1] if m else line).strip())
        elif kind == "row":
            bare = re.sub(r"^[ \t]*(?:\|-+[ \t]*)?[|!]?", "", line).strip().strip("|")
            cells = [c for c in (_inline(x).strip() for x in re.split(r"\|+|!!|</t[dh]>\s*<t[dh][^>]*>|(?<!\\)&(?!#?\w+;)(?!\w)|\\\\", bare)) if c]
            if cells:
                out.append(" | ".join(cells))
        else:
            out.append(_inline(line).strip() if kind == "text" else line.strip())
    if inside or fenced:
        while out and not out[-1]:
            out.pop()
        out.append("```")
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


def trained_model(docs: DataFrame, chunks: DataFrame) -> ContentModel:
    """Content potentials from at most TRAINING documents (drawn by a hash of the id) and the kinds of their active chunks."""
    some = _some(docs, "id", "snapshot").withColumnRenamed("key", "id")
    spans = chunks.where("active and kind is not null and start_line is not null and end_line is not null").select(F.col("doc_id").alias("id"), "start_line", "end_line", (F.col("kind") == "body").alias("body")).distinct()
    rows = some.join(spans, "id").groupBy("id").agg(F.first("text").alias("text"), F.collect_list(F.struct("start_line", "end_line", "body")).alias("spans")).orderBy("id").collect()
    return ContentModel.trained([(r["text"], [(s[0], s[1], s[2]) for s in r["spans"]]) for r in rows])


def cleaned(rows: DataFrame, model: ContentModel, id_col: str, text: str, least: float = 0.5) -> DataFrame:
    """(id, text): clean text of every row; null stays null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"i": b["i"], "text": [clean(t, model, least) for t in b["t"]]})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("i"), F.col(text).alias("t")).mapInPandas(run, f"i {kind}, text string").withColumnRenamed("i", id_col)
