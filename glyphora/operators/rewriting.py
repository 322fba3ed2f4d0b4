"""Search-and-replace and re-spelling of names: signs are replaced by others of the same glyphs, and inherit what they cover.

Old and new signs are laid over the glyph components that both stand for. A new sign takes line, condition, marks and
comment from the old signs that it covers; it is invalid if they are on several lines, if their conditions don't merge,
if an inversion or ligature would fall inside of it, or if more than one of them has a comment.
"""

from __future__ import annotations

from dataclasses import dataclass

from glyphora.operators.editing import Text

_OWN = ("value_id", "sign_variant_id", "custom_value", "type", "indicator_type", "phonographic")


class Invalid(ValueError):
    """Why a passage can't be rewritten."""


@dataclass
class Sign:
    """A sign of a text or pattern: its row, glyphs, and how it is joined to what stands before (sign, word or compound)."""

    row: dict
    glyphs: tuple
    link: str
    capital: bool = False
    compound: dict | None = None  # attributes of the compound that it starts
    reference: int | None = None
    old: bool = False


def merged_condition(conditions: list[str]) -> str:
    kinds = set(conditions)
    if len(kinds) == 1:
        return conditions[0]
    if kinds & {"inserted", "deleted"}:
        raise Invalid("conditions don't merge")
    return "damaged"


def signs_of(text: Text, glyphs: list[tuple]) -> list[Sign]:
    t, out = text.tables, []
    for k, row in enumerate(t["corpus"]):
        before = t["corpus"][k - 1] if k else None
        word = t["words"][row["word_no"]]
        link = "sign"
        if before is None or before["word_no"] != row["word_no"]:
            link = "word" if before is not None and t["words"][before["word_no"]]["compound_no"] == word["compound_no"] else "compound"
        compound = t["compounds"][word["compound_no"]] if link == "compound" else None
        out.append(Sign(row, tuple(glyphs[k] or ()), link, bool(word["capitalized"]), compound, old=True))
    return out


def _expanded(pattern: list[Sign], signs: list[Sign], captures: dict[int, list[int]]) -> list[Sign]:
    """The pattern with captured signs in place of its references."""
    out = []
    for p in pattern:
        if p.reference is None:
            out.append(p)
            continue
        if p.reference not in captures:
            raise Invalid(f"no capture {p.reference}")
        for k, no in enumerate(captures[p.reference]):
            s = signs[no]
            first = k == 0
            out.append(Sign(s.row, s.glyphs, p.link if first else s.link, s.capital, p.compound if first else s.compound))
    return out


def _spans(signs: list[Sign]) -> list[tuple[int, int]]:
    out, at = [], 0
    for s in signs:
        out.append((at, at + len(s.glyphs)))
        at += len(s.glyphs)
    return out


def replaced(signs: list[Sign], nos: list[int], new: list[Sign]) -> list[list[Sign]]:
    """New signs for the old ones at nos, in groups of consecutive old numbers. Raises Invalid."""
    old = [signs[n] for n in nos]
    if not all(s.glyphs for s in (*old, *new)) or [g for s in old for g in s.glyphs] != [g for s in new for g in s.glyphs]:
        raise Invalid("other glyphs")
    spans, gaps = _spans(old), {}
    for k in range(1, len(nos)):
        if nos[k] != nos[k - 1] + 1:
            gaps[spans[k][0]] = k
    starts = {a: s for (a, _), s in zip(spans, old, strict=True)}
    groups: list[list[Sign]] = [[]]
    touched = {id(s) for s in old}
    remarks = [c for c in _compounds(signs, touched) if c.get("compound_comment")]
    if remarks and (len(_compounds(signs, touched)) > 1 or any(s.link == "compound" for s in new[1:])):
        raise Invalid("a compound's comment would be lost")
    for k, ((a, b), s) in enumerate(zip(_spans(new), new, strict=True)):
        if any(a < g < b for g in gaps):
            raise Invalid("a gap inside a sign")
        if a in gaps:
            if s.link != "compound":
                raise Invalid("joined over a gap")
            groups.append([])
        under = [(x, o) for (x, y), o in zip(spans, old, strict=True) if x < b and y > a]
        inner = [o for x, o in under if x > a]
        rows = [o.row for _, o in under]
        if len({r["line_no"] for r in rows}) > 1:
            raise Invalid("several lines")
        if any(o.row["inverted"] or o.row["ligature"] for o in inner):
            raise Invalid("inverted or in ligature")
        comments = [r["comment"] for r in rows if r["comment"]]
        if len(comments) > 1 or sum(bool(o.row["newline"]) for _, o in under) > 1:
            raise Invalid("several comments or line breaks")
        at_start = starts.get(a)
        stems = {r["stem"] for r in rows}
        row = {c: s.row[c] for c in _OWN} | {
            "line_no": rows[0]["line_no"],
            "stem": stems.pop() if len(stems) == 1 else None,
            "condition": merged_condition([r["condition"] for r in rows]),
            "crits": "".join(dict.fromkeys(r["crits"] for r in rows if r["crits"])) or None,
            "comment": comments[0] if comments else None,
            "newline": any(o.row["newline"] for _, o in under if o is at_start or o in inner),
            "inverted": bool(at_start and at_start.row["inverted"]),
            "ligature": bool(at_start and at_start.row["ligature"]),
        }
        first = k == 0 or a in gaps
        link, capital, compound = (at_start.link, at_start.capital if at_start.link != "sign" else s.capital, at_start.compound) if first else (s.link, s.capital, s.compound)
        groups[-1].append(Sign(row, s.glyphs, link, capital, compound))
    return groups


def _compounds(signs: list[Sign], touched: set[int]) -> list[dict]:
    """Attributes of compounds with a touched sign."""
    out, now = [], None
    for s in signs:
        now = s.compound if s.link == "compound" else now
        if id(s) in touched and now is not None and all(now is not c for c in out):
            out.append(now)
    return out


def rebuilt(text: Text, signs: list[Sign]) -> Text:
    """The text with these signs; words and compounds follow from their links. Compounds keep their section."""
    words, compounds, rows, section = [], [], [], None
    for s in signs:
        if s.link == "compound" or not compounds:
            given = s.compound or {}
            section = given.get("section_no", section)
            compounds.append({"pn_type": given.get("pn_type"), "language": given.get("language"), "section_no": section, "compound_comment": given.get("compound_comment")})
        if s.link != "sign" or not words:
            words.append({"compound_no": len(compounds) - 1, "capitalized": s.capital})
        rows.append({**s.row, "word_no": len(words) - 1})
    return Text(text.tables | {"words": words, "compounds": compounds, "corpus": rows})


def replace(text: Text, glyphs: list[tuple], matches: list[tuple[list[int], dict[int, list[int]]]], pattern: list[Sign]) -> Text:
    """text with all matches (sign numbers, captures) replaced. Raises Invalid if any can't be, or if two overlap.

    A match that begins or ends inside of a sign, or stands for other glyphs than the pattern, is none.
    """
    signs = signs_of(text, glyphs)
    new = {}
    for k, (nos, captures) in enumerate(matches):
        with_references = _expanded(pattern, signs, captures)
        if [g for n in nos for g in signs[n].glyphs] == [g for s in with_references for g in s.glyphs]:
            new[k] = with_references
    matches = [m for k, m in enumerate(matches) if k in new]
    fresh = list(new.values())
    seen: set[int] = set()
    for nos, _ in matches:
        if seen & set(nos):
            raise Invalid("matches overlap")
        seen |= set(nos)
    instead: dict[int, list[Sign]] = {}
    gone: set[int] = set()
    for (nos, _), with_references in zip(matches, fresh, strict=True):
        groups = replaced(signs, nos, with_references)
        begins = [n for k, n in enumerate(nos) if not k or n != nos[k - 1] + 1]
        if len(groups) != len(begins):
            raise Invalid("another number of passages")
        instead |= dict(zip(begins, groups, strict=True))
        gone |= set(nos)
    out = []
    for k, s in enumerate(signs):
        out += instead.get(k, [] if k in gone else [s])
    return rebuilt(text, out)


def aligned(signs: list[Sign], spelling: list[list[Sign]], least: int) -> list[Sign] | None:
    """One variant per sign of a name, so that their glyphs are those of the first signs, up to a sign's end at `least` glyphs or more.

    spelling: variants of each sign, the plainest first. The plainest such way; None if there is none.
    """
    have = [g for s in signs for g in s.glyphs]
    ends = {b for _, b in _spans(signs)}
    ways: list[tuple[int, list[Sign]]] = [(0, [])]
    for options in spelling:
        ways = [(at + len(o.glyphs), [*way, o]) for at, way in ways for o in options if o.glyphs and tuple(have[at : at + len(o.glyphs)]) == o.glyphs]
    fit = [w for at, w in ways if at in ends and at >= least]
    return fit[0] if fit else None


def segments(old: list[Sign], new: list[Sign]) -> list[tuple[range, range]]:
    """Shortest runs of old and new signs that cover the same glyphs."""
    a, b = {y: k + 1 for k, (_, y) in enumerate(_spans(old))}, {y: k + 1 for k, (_, y) in enumerate(_spans(new))}
    out, i, j = [], 0, 0
    for cut in sorted(a.keys() & b.keys()):
        out.append((range(i, a[cut]), range(j, b[cut])))
        i, j = a[cut], b[cut]
    return out


def respell(text: Text, glyphs: list[tuple], compound_no: int, spelling: list[list[Sign]]) -> Text:
    """text with a compound's beginning written as a name is spelled, segment by segment; segments that can't be stay."""
    signs = signs_of(text, glyphs)
    t = text.tables
    own = [k for k, r in enumerate(t["corpus"]) if t["words"][r["word_no"]]["compound_no"] == compound_no]
    stem = max((i + 1 for i, k in enumerate(own) if t["corpus"][k]["stem"]), default=len(own))  # without stems, all of it
    new = aligned([signs[k] for k in own], spelling, sum(len(signs[k].glyphs) for k in own[:stem]))
    if new is None:
        return text
    size = sum(len(s.glyphs) for s in new)
    out, used = list(signs[: own[0]]), 0
    for olds, news in segments([signs[k] for k in own], new):
        nos = [own[k] for k in olds]
        try:
            if used >= size:
                raise Invalid("behind the name")
            out += [s for group in replaced(signs, nos, [new[k] for k in news]) for s in group]
        except Invalid:
            out += [signs[n] for n in nos]
        used += sum(len(signs[n].glyphs) for n in nos)
    done = out[own[0] :]
    covered = sum(len(s.glyphs) for s in done)
    rest = [signs[k] for k in own if _place(signs, own, k) >= covered]
    return rebuilt(text, [*out, *rest, *signs[own[-1] + 1 :]])


def _place(signs: list[Sign], own: list[int], k: int) -> int:
    return sum(len(signs[n].glyphs) for n in own if n < k)
