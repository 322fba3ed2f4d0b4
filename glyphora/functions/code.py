"""Reader of transliteration code: a document's text -> rows of its seven tables, and errors.

    document  @surface-type data, @block-type data, `line name TAB content`, `# comment` on what stands before
    content   compounds by space, words by --, signs by - or . ; the end of a line without a mark ends a compound
    marks     %sec=NAME %sec, %a %e %h %s %u, %person …, %st+ %st- ; & capital word, ; where a stem begins or ends,
              { } < > indicators, _ _ logograms, [ ] ⸢ ⸣ ‹ › « » conditions, : inversion, + ligature, / new line
    signs     value, value(SPEC), SIGN, |SIGN.SIGN|, numbers, "description", … ; then !?* marks and (comment)
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Marks of the notation.
LANGUAGES = {"a": "akkadian", "e": "eblaite", "h": "hittite", "s": "sumerian", "u": None}
NAMES = ["person", "god", "place", "water", "field", "temple", "month", "object", "ethnicity"]
OPENS = {"[": "lost", "⸢": "damaged", "‹": "inserted", "«": "deleted"}
CLOSES = {"]": "lost", "⸣": "damaged", "›": "inserted", "»": "deleted"}
SURFACES = {"obverse", "reverse", "top", "bottom", "left", "right", "fragment", "surface"}
BLOCKS = {"column", "summary", "date", "caption", "legend", "bottom_column", "block"}
_LOW, _UP = "a-zß-öø-ÿĝḫřšṣṭ’", "A-ZÀ-ÖØ-ÞĜḪŘŠṢṬ’"
_NAME = rf"(?:[{_UP}]+[0-9x]*|\([^()]*\))(?:@(?:180|90|45|[tgšnkzicdfvabx4]))*"
_SIGN = rf"{_NAME}(?:[×.%&@]{_NAME})*"
TOKEN = re.compile(
    rf"""(?P<section>%sec(?:=(?P<name>\S+))?(?:\s+|$))|(?P<stem>%st(?P<st>[+-])(?:\s+|$))|(?P<language>%(?P<lang>[aehsu])(?:\s+|$))
    |(?P<pn>%(?P<kind>{"|".join(NAMES)})(?:\s+|$))|(?P<word>--)|(?P<space>\ +(?!\())|(?P<remark>\ +\((?P<text>[^()]*)\))|\|(?P<sign>{_SIGN})\||(?P<text_>"[^"]*")
    |(?P<value>[{_LOW}]+[0-9]*x?)|(?P<bare>{_NAME.replace(r"|\([^()]*\)", "")})|(?P<number>[0-9]+(?:/[0-9]+)?)|(?P<damage>…)
    |(?P<mark>[-.:+/;&{{}}<>_\[\]⸢⸣‹›«»~])""",
    re.X,
)
SPEC, CRITS, COMMENT = re.compile(rf"!?\(({_SIGN})\)"), re.compile(r"[!?*]+"), re.compile(r"\(([^()]*)\)")


@dataclass
class Document:
    surfaces: list = field(default_factory=list)  # surface_type, surface_data, surface_comment
    blocks: list = field(default_factory=list)  # surface_no, block_type, block_data, block_comment
    lines: list = field(default_factory=list)  # block_no, line, line_comment
    sections: list = field(default_factory=list)  # section_name
    compounds: list = field(default_factory=list)  # pn_type, language, section_no, compound_comment
    words: list = field(default_factory=list)  # compound_no, capitalized
    signs: list = field(default_factory=list)  # dicts
    errors: list = field(default_factory=list)  # line, col, symbol, message


class _Reader:
    def __init__(self):
        self.doc = Document()
        self.language = self.section = None
        self.stems = False
        self.pn = None
        self.link = "space"  # what stands between the last sign and the next
        self.flags: set[str] = set()
        self.condition = "intact"
        self.indicator: str | None = None
        self.logogram = False
        self.capital = False
        self.stem_of_word: list[int] = []
        self.edge: bool | None = None
        self.after = True  # a connector or nothing stands before

    def document(self, code: str) -> Document:
        d, last = self.doc, None
        for row, text in enumerate(code.split("\n")):
            if not text.strip():
                continue
            if text.startswith("@"):
                kind, _, data = text[1:].partition(" ")
                if kind in SURFACES:
                    d.surfaces.append([kind, data or None, None])
                    last = (d.surfaces[-1], 2)
                elif kind in BLOCKS:
                    self.need_surface()
                    d.blocks.append([len(d.surfaces) - 1, kind, data or None, None])
                    last = (d.blocks[-1], 3)
                else:
                    d.errors.append((row, 0, kind, "unknown section of the object"))
            elif text.startswith("#"):
                if last:
                    last[0][last[1]] = text[1:].strip()
                else:
                    d.errors.append((row, 0, "#", "nothing to comment on"))
            else:
                name, tab, content = text.partition("\t")
                if not tab:
                    d.errors.append((row, len(text), "", "no tab behind the line's name"))
                    continue
                self.need_surface()
                if not d.blocks or d.blocks[-1][0] != len(d.surfaces) - 1:
                    d.blocks.append([len(d.surfaces) - 1, "block", None, None])
                d.lines.append([len(d.blocks) - 1, name, None])
                last = (d.lines[-1], 2)
                self.line(row, content, len(name) + 1)
        self.end_compound()
        return d

    def need_surface(self) -> None:
        if not self.doc.surfaces:
            self.doc.surfaces.append(["surface", None, None])

    def line(self, row: int, text: str, shift: int) -> None:
        at, d = 0, self.doc
        fresh = True
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                d.errors.append((row, at + shift, text[at], "unexpected character"))
                at += 1
                continue
            kind, at = m.lastgroup, m.end()
            if m["section"]:
                self.end_compound()
                self.link, self.section = "space", None
                if m["name"]:
                    if not d.sections or d.sections[-1][0] != m["name"]:
                        d.sections.append([m["name"]])
                    self.section = len(d.sections) - 1
            elif m["stem"]:
                self.end_compound()
                self.stems = m["st"] == "+"
            elif m["language"]:
                self.end_compound()
                self.link, self.language = "space", LANGUAGES[m["lang"]]
            elif m["pn"]:
                self.end_compound()
                self.link, self.pn = "space", m["kind"]
            elif m["remark"]:
                if d.compounds:
                    d.compounds[-1][3] = m["text"]
            elif m["space"]:
                self.link = "space"
                self.after = True
            elif m["word"]:
                self.link, self.after = "word", True
            elif m["mark"]:
                self.mark(m["mark"], text, at)
            else:
                raw = m["sign"] or m[kind]
                what = {"sign": "sign", "bare": "sign", "text_": "description"}.get(kind, kind)
                at = self.sign(what, raw.strip('"'), text, at, fresh)
                fresh = False
        if self.after and self.link != "space" and not fresh:
            pass  # the connector at the line's end holds on
        elif not fresh:
            self.link, self.after = "space", True
        self.flags.discard("newline")

    def mark(self, c: str, text: str, at: int) -> None:
        if c in OPENS:
            self.condition = OPENS[c]
        elif c in CLOSES:
            self.condition = "intact"
        elif c in "{<":
            self.indicator = c
            if self.after:
                self.side = "right"  # it belongs to what stands right of it
            else:
                self.side, self.link = "left", "none"
        elif c in "}>":
            self.indicator, self.link, self.after = None, "none", False
            self.closed = True
        elif c == "_":
            self.logogram = not self.logogram
        elif c == "&":
            self.capital = True
        elif c == ";":
            self.edge = self.after and self.link != "space"  # behind a connector: the stem begins here
            self.cut_stem()
        elif c in "-.":
            self.link, self.after = "sign", True
        elif c == "~":
            self.link, self.after = "sign", True
        elif c == ":":
            self.flags.add("inverted")
            self.link, self.after = (self.link if self.after and self.link in ("space", "word") and self.doc.signs else "sign"), True
        elif c == "+":
            self.flags.add("ligature")
            self.link, self.after = (self.link if self.after and self.link in ("word",) else "sign"), True
        elif c == "/":
            self.flags.add("newline")
            self.link, self.after = (self.link if self.after else "sign"), True

    def cut_stem(self) -> None:
        """Marks the signs of the word so far: before the stem if it begins here, else in it."""
        word = [s for s in self.doc.signs if s["word_no"] == len(self.doc.words) - 1]
        begins = self.after and self.link in ("sign", "none")
        for s in word:
            if s["stem"] is None or s.get("open"):
                s["stem"] = not begins
                s["open"] = False
        self.now = begins
        self.word_stem = len(self.doc.words) - 1

    now, word_stem, side, closed, ended = None, -1, None, False, 0

    def end_compound(self) -> None:
        """If any sign of the compound has a stem mark, or stems are asked for, all have one."""
        d = self.doc
        if len(d.compounds) == self.ended:
            return
        self.ended = len(d.compounds)
        own = {k for k, w in enumerate(d.words) if w[0] == len(d.compounds) - 1}
        signs = [s for s in d.signs if s["word_no"] in own]
        if self.stems or any(s["stem"] is not None for s in signs):
            for s in signs:
                if s["stem"] is None:
                    s["stem"] = True

    def sign(self, kind: str, raw: str, text: str, at: int, fresh: bool) -> int:
        d, spec, crits, comment = self.doc, None, None, None
        if m := SPEC.match(text, at):
            spec, at = m[1], m.end()
        if m := CRITS.match(text, at):
            crits, at = m[0], m.end()
        if m := COMMENT.match(text, at):
            comment, at = m[1], m.end()
        link = self.link if d.signs else "space"
        if self.closed and self.indicator is None and link == "none":
            link = "none"
        if link == "space":
            self.end_compound()
            d.compounds.append([self.pn, self.language, self.section, None])
            d.words.append([len(d.compounds) - 1, self.pn is not None])
            self.pn = None
        elif link == "word":
            d.words.append([len(d.compounds) - 1, False])
        if self.capital:
            d.words[-1][1] = True
            self.capital = False
        stem = self.now if self.word_stem == len(d.words) - 1 else None
        indicator = self.indicator
        d.signs.append(
            {
                "line_no": len(d.lines) - 1,
                "word_no": len(d.words) - 1,
                "value": raw,
                "sign_spec": spec,
                "type": kind,
                "indicator_type": self.side if indicator else "none",
                "phonographic": (indicator == "<") if indicator else False if self.logogram else None,
                "stem": stem,
                "condition": self.condition,
                "crits": crits,
                "comment": comment,
                "newline": "newline" in self.flags,
                "inverted": "inverted" in self.flags,
                "ligature": "ligature" in self.flags,
            }
        )
        self.flags, self.closed = set(), False
        self.link, self.after = "sign?", False
        return at


def read(code: str) -> Document:
    return _Reader().document(code)
