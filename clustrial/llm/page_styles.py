"""What the style sheets of a page say of display and visibility, by tag, class and id."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

PROPERTIES = {"display", "visibility", "content-visibility"}
#: Words that leave a property to the browser, and the visibilities there are.
_UNSAID = {"revert", "revert-layer"}
_VISIBLE = {"visible", "hidden", "collapse", "initial", "inherit", "unset"}

_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_TEXT = re.compile(r'"[^"\n]*"|\'[^\'\n]*\'')
_MARK = re.compile(r"[{};]")
_BRACE = re.compile(r"[{}]")
_SIMPLE = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)", re.I)
_PART = re.compile(r"([.#])([\w-]+)")
_HERE = re.compile(r"@media\s+(?:only\s+)?(?:screen|all)\s*|@layer\b.*|@supports\s*\(.*", re.I | re.S)
_SCREEN = re.compile(r"\s*(?:(?:only\s+)?(?:screen|all))?\s*", re.I)


def for_screen(media: str | None) -> bool:
    """Whether a sheet's ``media`` attribute asks for no more than a screen."""
    return any(_SCREEN.fullmatch(part) for part in (media or "").split(","))


def declared(text: str) -> list[tuple[str, str, bool]]:
    """Property, value and importance of the declarations in ``text`` that count here."""
    found = []
    for part in text.split(";"):
        name, colon, value = part.partition(":")
        name = name.strip().lower()
        if not colon or name not in PROPERTIES:
            continue
        value = value.strip().lower()
        important = value.endswith("important") and value[:-9].rstrip().endswith("!")
        if important:
            value = value[:-9].rstrip()[:-1].rstrip()
        if re.fullmatch(r"[a-z-]+(?: [a-z-]+)*", value) and (name != "visibility" or value in _VISIBLE | _UNSAID):
            found.append((name, value, important))
    return found


def _rules(css: str) -> Iterator[tuple]:
    """Tag, classes and ids, weight and declarations of the rules for one element each."""
    css = _TEXT.sub("''", _COMMENT.sub(" ", css))
    at = 0
    while m := _MARK.search(css, at):
        head, at = css[at : m.start()].strip(), m.end()
        if m[0] != "{" or _HERE.fullmatch(head):
            continue
        if head.startswith("@"):
            depth = 1
            while depth and (brace := _BRACE.search(css, at)):
                depth += 1 if brace[0] == "{" else -1
                at = brace.end()
            if depth:
                return
            continue
        end = css.find("}", at)
        end = len(css) if end < 0 else end
        said = declared(css[at:end])
        at = min(end + 1, len(css))
        for selector in head.split(",") if said else ():
            simple = _SIMPLE.fullmatch(selector.strip())
            if simple and simple[0]:
                tag, parts = (simple[1] or "*").lower(), frozenset(_PART.findall(simple[2]))
                ids = sum(kind == "#" for kind, _ in parts)
                yield tag, parts, (ids, len(parts) - ids, tag != "*"), said


class StyleSheet:
    """Rules of one page. Selectors of more than one element, states and attributes are passed over."""

    def __init__(self, sheets: Iterable[str]):
        rules: dict[tuple, tuple] = {}  # of equal rules the last one counts
        order = 0
        for css in sheets:
            for tag, parts, weight, said in _rules(css):
                for name, value, important in said:
                    order += 1
                    rules[tag, parts, name, important] = (important, False, weight, order, value)
        often = Counter(part for _, parts, _, _ in rules for part in parts)
        self._rules = defaultdict(list)  # under the part that fewest rules have
        for (tag, parts, name, _), strength in rules.items():
            key = min(parts, key=lambda part: (often[part], part)) if parts else ("", tag)
            self._rules[key].append((tag, parts, name, strength))
        self._known: dict[tuple, dict] = {}

    def _strongest(self, tag: str, own_id: str, classes: str) -> dict[str, tuple]:
        key = (tag, own_id, classes)
        if key not in self._known:
            parts = {(".", c) for c in classes.split()} | ({("#", own_id)} if own_id else set())
            best: dict[str, tuple] = {}
            for part in (*parts, ("", tag), ("", "*")):
                for want, needed, name, strength in self._rules.get(part, ()):
                    if want in ("*", tag) and needed <= parts and (name not in best or strength > best[name]):
                        best[name] = strength
            self._known[key] = best
        return self._known[key]

    def says(self, tag: str, attrs: dict[str, str]) -> dict[str, str]:
        """The properties that the sheet and the element's own style set, the stronger of both."""
        best = self._strongest(tag, attrs.get("id", ""), attrs.get("class", "")) if self._rules else {}
        if "style" in attrs:
            best = dict(best)
            for order, (name, value, important) in enumerate(declared(attrs["style"])):
                strength = (important, True, (0, 0, False), order, value)
                if name not in best or strength > best[name]:
                    best[name] = strength
        return {name: strength[-1] for name, strength in best.items() if strength[-1] not in _UNSAID}
