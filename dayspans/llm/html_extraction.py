"""Main text of web pages by tag-path ratios.

Every text has a root-to-leaf tag path, and an article element starts paths of its own. Per path the text length and the
punctuation are taken per block, smoothed over neighbouring blocks in page order and fused to one score, which is raised
inside article and main elements; paths above a threshold are content. Content blocks are kept, and with them the text of
their common ancestor, apart from containers without any content (teasers, cards) and from parts that are marked as
something else (menus, adverts, forms, comments and the like). A marked part that holds most of the page's content is not
dropped for a word: marks are held against what would remain.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose text is never shown or never article; elements that stand alone; elements whose text is a block.
SKIP = frozenset("script style head title nav footer header aside noscript template iframe object svg math canvas audio video button select textarea option dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that an opening tag of the key ends, if they are open inside the same list, table or block.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article section main div body html td th blockquote".split())
#: Elements that may be the article's container.
CONTAINERS = frozenset("article main section div body td html".split())
#: Words of class, id or role that mark a part as not article; those of readers' comments; words that speak for an article.
MARKS = re.compile(r"(?:^|[_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice\w*|popup|modal|overlay|newsletter|subscribe|signup|nav\w*|menu\w*|breadcrumbs?|pagination|pager|sidebar\w*|side|aside|widget\w*|footer\w*|header|masthead|comments?|disqus|respond|replies|reply|share|sharing|social|related|recommend\w*|toolbar|login|search|complementary|navigation|contentinfo)(?:$|[_-])", re.I)
READERS = re.compile(r"(?:^|[_-])(?:comments?|disqus|respond|replies|reply)(?:$|[_-])", re.I)
STORIES = re.compile(r"(?:^|[_-])(?:article|story|content|main|post|entry|body|text|page|primary)(?:$|[_-])", re.I)
#: Names that say what is beside an element, how it looks or what it can do, not what it is.
BESIDE = re.compile(r"(?:has|with|without|no|not|is)[-_]|.*[-_](?:enabled|disabled|allowed|open|opened|closed|active|ready)$", re.I | re.S)
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: A tag: a quote counts only after an equals sign, and one that never ends is an ordinary character. Nothing is tried twice.
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?+|[\"'])*+)>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?+")
#: Attributes that may mark an element.
MARKING = re.compile(r"class|id|role|hidden|style", re.I)
COMMENT_END = re.compile(r"--!?>")
PUNCTUATION = re.compile(r"[.,;:!?…。、！？;]")
#: Neighbours on either side that smooth a block's ratios; part of the mean score of a character that a content path needs.
SMOOTH, THRESHOLD = 1, 0.3
#: Factor of the score inside article and main elements.
NAMED = 1.5
#: How many times the content of all unmarked parts a marked part needs to count as the article after all: one that also has a
#: word for an article or is a form, any other; readers' comments need a page without other content. Characters it needs.
DOUBTFUL, MARKED, LEAST = 2.0, 8.0, 100
#: Characters of a block with punctuation that count as content when marks are judged.
SENTENCE = 25


class Element:
    """An open element: its tag and number, and what it has from the elements around it, so that no text walks up the page.

    ``path``: number of its root-to-leaf path of block elements; ``article``: number of the innermost article element;
    ``named``: inside an article or main; ``gone``: inside a part that is never article; ``mark``: the innermost part
    around it that is marked as something else; ``box``: the innermost container; ``blocks``: block elements up to it.
    """

    __slots__ = ("tag", "path", "article", "named", "gone", "mark", "box", "blocks")

    def __init__(self, tag: str, number: int, up: Element | None, path: int, gone: bool, weight: float):
        self.tag, self.path = tag, path
        self.article = number if tag == "article" else up.article if up else 0
        self.named = tag in ("article", "main") or bool(up and up.named)
        self.gone = gone or bool(up and up.gone)
        around = up.mark if up else None
        self.mark = Mark(around, weight) if weight and not self.gone else around
        around = up.box if up else None
        self.box = Box(number, tag, around) if tag in CONTAINERS else around
        self.blocks = (up.blocks if up else 0) + (tag not in INLINE)


class Box:
    """An element that may contain the article."""

    __slots__ = ("number", "tag", "up", "depth")

    def __init__(self, number: int, tag: str, up: Box | None):
        self.number, self.tag, self.up, self.depth = number, tag, up, up.depth + 1 if up else 1


class Mark:
    """A part that is marked as not article: the marked part around it, and how much its mark weighs."""

    __slots__ = ("up", "weight", "void")

    def __init__(self, up: Mark | None, weight: float):
        self.up, self.weight, self.void = up, weight, False


def judged_tag(name: str, attributes: str) -> tuple[bool, float]:
    """(whether an element is never article, how much its mark weighs) by its name, by words in class, id or role, or because
    it is hidden. A mark of 0 is none; the others are held against the page's content, see ``void_marks``.
    """
    if name in SKIP:
        return True, 0.0
    weight = DOUBTFUL if name == "form" else 0.0
    if not attributes or not MARKING.search(attributes):
        return False, weight
    given = {m.group(1).lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(attributes)}
    if name in ("html", "body"):
        return False, 0.0
    if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or UNSEEN.search(given.get("style", "")):
        return True, 0.0
    words = [w for key in ("class", "id", "role") for w in given.get(key, "").split() if not BESIDE.match(w)]
    marks = [w for w in words if MARKS.search(w)]
    if any(READERS.search(w) for w in marks):
        return False, float("inf")
    if marks:
        return False, DOUBTFUL if name in ("form", "article", "main") or any(STORIES.search(w) for w in words if w not in marks) else MARKED
    return False, weight


def nodes(page: str) -> Iterator[tuple[str, Element | None, int]]:
    """(text, innermost open element, block) of every text node in page order; ``block`` is a number that all text of one
    block has. Unclosed elements end where HTML lets them end; a stray end tag is ignored. Elements nest to any depth. What
    is inside scripts, styles and the like is never read as tags. Work is linear in the length of the page.
    """
    stack: list[Element] = []
    places: dict[str, list[int]] = {}
    scopes: list[int] = []
    paths: dict[tuple[int, str], int] = {}
    block, number, at, seen = 0, 0, 0, 0  # seen: from here on the page is text, unless a tag is found
    top = lambda: stack[-1] if stack else None
    place = lambda name: places[name][-1] if places.get(name) else -1

    def close(to: int) -> None:
        for e in stack[to:]:
            places[e.tag].pop()
            if e.tag in SCOPE:
                scopes.pop()
        del stack[to:]

    while (low := page.find("<", at)) >= 0:
        after = page[low + 1 : low + 2]
        m = TAG.match(page, low) if after == "/" or after.isalpha() and after.isascii() else None
        if m:
            end = m.end()
        elif after.isalpha() and after.isascii() or after == "/" and page[low + 2 : low + 3].isalpha() and page[low + 2 : low + 3].isascii():
            end = len(page)  # a tag that never ends
        elif page.startswith("<!--", low):
            found = COMMENT_END.search(page, low + 2)
            end = found.end() if found else len(page)
        elif after and after in "!?/":
            close_by = "]]>" if page.startswith("<![CDATA[", low) else ">"
            found_at = page.find(close_by, low)
            end = found_at + len(close_by) if found_at >= 0 else len(page)
        else:  # an ordinary character
            at = low + 1
            continue
        if low > seen:
            yield page[seen:low], top(), block
        at = seen = end
        if not m:
            continue
        closing, name, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if name not in INLINE:
            block += 1
        if closing:
            depth = place(name)
            if depth >= 0 and not (name in INLINE and stack[-1].blocks > stack[depth].blocks):
                close(depth)
            continue
        scope = scopes[-1] if scopes else -1
        if name not in INLINE and place("p") > scope:  # a block ends an open paragraph and the inline elements in it
            close(place("p"))
        if (to := max((place(x) for x in ENDS.get(name, ())), default=-1)) >= 0 and to >= scope:
            close(to)
        if name in VOID or attributes.endswith("/"):
            if name == "br":
                yield " ", top(), block
            continue
        number += 1
        up = top()
        path = up.path if up else 0
        if name not in INLINE:
            path = paths.setdefault((path, name), len(paths) + 1)
        places.setdefault(name, []).append(len(stack))
        if name in SCOPE:
            scopes.append(len(stack))
        stack.append(Element(name, number, up, path, *judged_tag(name, attributes)))
        if name in RAW:
            raw = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = raw.start() if raw else len(page)
    if seen < len(page):
        yield page[seen:], top(), block


def void_marks(found: list[tuple]) -> None:
    """Void the marks around the part that holds most of the page's content, where little else does.

    Content is the text of blocks with a sentence. A mark of some weight needs that many times the content of all unmarked
    parts; where unmarked content lies in an article element, no mark is void. Once the fullest part is taken in, the marks
    around it are held against the rest in turn.
    """
    size: dict[int, int] = {}
    sentences: set[int] = set()
    for text, _, block in found:
        size[block] = size.get(block, 0) + len(text.strip())
        if PUNCTUATION.search(text):
            sentences.add(block)
    inside: dict[Mark | None, int] = {}
    named = False
    for text, e, block in found:
        if block in sentences and size[block] >= SENTENCE:
            mark = e.mark if e else None
            inside[mark] = inside.get(mark, 0) + len(text.strip())
            named |= mark is None and bool(e and e.article)
    outside = inside.pop(None, 0)
    best = max(inside, key=inside.get, default=None)
    held = 0
    while best is not None and not named:
        held += inside.get(best, 0)
        if held < LEAST or (outside > 0 if best.weight == float("inf") else held <= best.weight * outside):
            break
        best.void, best = True, best.up


def smooth(values: list[float], groups: list[int]) -> list[float]:
    """Mean over each value and its neighbours of the same group."""
    out = []
    for i, g in enumerate(groups):
        own = [values[j] for j in range(max(0, i - SMOOTH), min(len(values), i + SMOOTH + 1)) if groups[j] == g]
        out.append(sum(own) / len(own))
    return out


def content_nodes(found: list[tuple]) -> set[int]:
    """Indexes of the nodes whose paths are content, by fused and smoothed tag-path ratios.

    The texts of one path in one block, such as those around a link, count as one.
    """
    units: list[list] = []
    for i, (text, e, block) in enumerate(found):
        if not text.strip():
            continue
        article, path = (e.article, e.path) if e else (0, 0)
        if not units or units[-1][:3] != [article, path, block]:
            units.append([article, path, block, 0, 0, [], bool(e and e.named)])
        units[-1][3] += len(text.strip())
        units[-1][4] += len(PUNCTUATION.findall(text))
        units[-1][5].append(i)
    paths, groups = [(u[0], u[1]) for u in units], [u[0] for u in units]
    size, marks, count, total = {}, {}, {}, {}
    for p, u in zip(paths, units):
        size[p] = size.get(p, 0) + u[3]
        marks[p] = marks.get(p, 0) + u[4]
        count[p] = count.get(p, 0) + 1
    text_ratio = smooth([size[p] / count[p] for p in paths], groups)
    mark_ratio = smooth([marks[p] / count[p] for p in paths], groups)
    for p, u, t, m in zip(paths, units, text_ratio, mark_ratio):
        total[p] = total.get(p, 0.0) + t * (1 + m) * (NAMED if u[6] else 1)
    score = {p: total[p] / count[p] for p in total}
    least = THRESHOLD * sum(score[p] * size[p] for p in score) / max(sum(size.values()), 1)
    return {i for p, u in zip(paths, units) if score[p] >= least for i in u[5]}


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, white space inside a block as one space, joined by line ends.

    Kept are the content nodes, what else is in the containers that hold them, and what lies between these containers
    and the common ancestor of all content. An article element without content goes wherever it stands. A page without
    text gives an empty text. Pages are handled in time linear in their length, however broken.
    """
    found = [x for x in nodes(page or "") if not (x[1] and x[1].gone)]
    void_marks(found)
    out: dict[Mark | None, bool] = {None: False}
    for _, e, _ in found:
        mark, chain = e.mark if e else None, []
        while mark not in out:
            chain.append(mark)
            mark = mark.up
        for m in reversed(chain):
            out[m] = out[m.up] or not m.void
    found = [x for x in found if not out[x[1].mark if x[1] else None]]
    chosen = content_nodes(found)
    if not chosen:
        return ""
    boxes = [e.box if e else None for _, e, _ in found]
    holders = {boxes[i] for i in chosen}
    home = boxes[min(chosen)]
    above: set[Box | None] = {None}
    while home not in above:
        above.add(home)
        home = home.up
    home = boxes[min(chosen)]
    for box in holders:  # up to the common ancestor: where a way up meets the ways before it
        while box not in above:
            above.add(box)
            box = box.up
        if (box.depth if box else 0) < (home.depth if home else 0):
            home = box
    # Per container: whether it is in the common ancestor, whether it or one around it holds content, and whether every article around it does.
    known: dict[Box | None, tuple[bool, bool, bool]] = {None: (home is None, None in holders, True)}

    def judged(box: Box | None) -> tuple[bool, bool, bool]:
        chain = []
        while box not in known:
            chain.append(box)
            box = box.up
        for x in reversed(chain):
            inside, held, fine = known[x.up]
            known[x] = (inside or x is home, held or x in holders, fine and (x.tag != "article" or x in above))
        return known[chain[0] if chain else box]

    blocks: dict[int, list[str]] = {}
    for i, (text, _, block) in enumerate(found):
        inside, held, fine = judged(boxes[i])
        if i in chosen or inside and fine and (boxes[i] in above or held):
            blocks.setdefault(block, []).append(entities.unescape(text))
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, *, html_col: str = "html", into: str = "text") -> DataFrame:
    """Add column ``into``: the main text of every page, empty for null, empty or contentless html.

    Rows, repeats and other columns pass through; a column of the name ``into`` is replaced; an empty table gives an
    empty one. Pages are read whole, however long or deep.
    """

    @F.pandas_udf("string")
    def run(parts: pd.Series) -> pd.Series:
        return parts.map(main_text)

    return pages.withColumn(into, run(F.coalesce(F.col(html_col), F.lit(""))))


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    done = extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
