"""Main text of HTML pages by host suffix arrays.

1. Each page is split into blocks of text.  Structure labels a block as article, as chrome (menus,
   headers, footers, sidebars, notices, adverts, forms, comments), or leaves it open.  A class that only
   resembles the name of some furniture makes a block doubtful.
2. A page's blocks outside its article, and the doubtful ones inside, are one stream of tokens, and a host's
   streams are searched for substrings of ``min_tokens`` or more tokens that distinct pages repeat.  The
   suffix array is dealt by host and the suffixes' first ``min_tokens`` tokens: a repeat of that length or
   more is a run of suffixes that each share those first tokens with a suffix of another page, so a bucket
   need only know whether its suffixes come from more than one page, and what it covers is what neighbours
   in the sorted array would.  That is a hash aggregate with partial sums, and neither a host nor a frequent
   substring is ever gathered in one task.
3. Tokens so covered are boilerplate.  A doubtful block goes if the host repeats at least half of it.  The main
   text is the article, whole; or the main element, if there is no article or only a ``SHORT`` one and the
   main element has far more that is unique; or else, in the same way, the unique runs of the open blocks.
   Articles are not searched: pages of a host share quotations and copies, and dropping what they share
   would take text from more than half of the articles; even whole blocks at an article's end that three pages
   share are its own text far more often than the host's.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitspark.llm.scratch import Stored
from bitspark.llm.textkit import U, mix, words

# Element names as HTML defines them, and words that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object canvas audio video xmp annotation annotation-xml".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img "
    "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mprescripts none mtable mtr mtd mstyle mpadded mphantom menclose merror".split())
CHROME_TAGS = frozenset("nav header footer aside form button select option menu dialog head fieldset".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CHROME_WORDS = frozenset(
    "ad ads adbox adslot adunit adwrap adsense adsbygoogle advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navbox navigation menu menubar topmenu mainmenu "
    "submenu dropdown breadcrumb breadcrumbs sidebar aside widget widgets footer foot bottombar colophon header topbar masthead comment comments commentlist respond reply replies disqus cookie cookies "
    "consent gdpr notice notices alert toast disclaimer popup modal overlay newsletter subscribe signup share sharing social related recommended toolbar pagination pager login search skip".split()
)

#: Of these a part of a class is enough even inside an article: they name nothing that a text has sections about or tables of.
FURNITURE_WORDS = frozenset(
    "adbox adslot adunit adwrap adsense adsbygoogle advert adverts advertisement sponsored navbar navbox topmenu mainmenu submenu breadcrumb breadcrumbs sidebar bottombar topbar masthead comments "
    "commentlist disqus gdpr newsletter pager".split()
)
#: Names that an article also gives to parts of its own: warnings, title blocks, remarks at its foot.
OWN_WORDS = frozenset("alert header overlay notice notices search skip foot".split())
#: Words that make furniture of what stands beside them in a class.
PAIRED = {
    frozenset("ad ads".split()): frozenset("container slot unit wrap wrapper box banner block space zone area label top bottom inline leaderboard rectangle placeholder".split()),
    frozenset("cookie cookies consent privacy".split()): frozenset("banner notice consent bar popup message wall overlay warning dialog".split()),
    frozenset("share sharing social".split()): frozenset("link links button buttons bar icon icons tools widget box list".split()),
    frozenset("related recommended more".split()): frozenset("post posts article articles link links story stories reading".split()),
    frozenset(["login", "search"]): frozenset("form bar button".split()),
}

NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
QUOTES = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
MARKED = re.compile(r"class|id|role|hidden|style")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("div section ul ol dl table".split())
#: Names with one of these say that an element goes with or without furniture, not that it is some.
RELATIONS = frozenset("no non not with without has hide show".split())
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
PLAIN, ARTICLE, MAIN, CHROME, WRAPPED = 0, 1, 2, 3, 4  # WRAPPED: an article inside what looks like furniture
NEITHER, DOUBTFUL, CERTAIN = 0, 1, 2  # whether an element is furniture
#: An article of fewer tokens than this gives way to other text that is ``TIMES`` as long and that the host doesn't repeat.
SHORT, TIMES = 25, 4


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)}


def _furniture(tag: str, attrs: dict[str, str], in_article: bool = False) -> int:
    """Whether an element is furniture.

    Certain are elements and roles that mean it, hidden ones, a class or id that is a furniture word as a
    whole, and a class with one of ``FURNITURE_WORDS`` or two words that are ``PAIRED``.  A class with another such word in it is doubtful.
    Inside an article ids are commonly slugs of headings: only a container's counts, if it is one of ``FURNITURE_WORDS`` as a
    whole; and a class that is one of ``OWN_WORDS`` is doubtful.
    """
    if tag in ("html", "body", "article", "main"):
        return NEITHER
    if tag in CHROME_TAGS or attrs.get("role", "").lower() in CHROME_ROLES:
        return CERTAIN
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return CERTAIN
    found = NEITHER
    for kind in ("id", "class"):
        for name in attrs.get(kind, "").split():
            parts = re.findall(r"[a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            if RELATIONS.intersection(parts[:-1]):
                continue
            whole = "".join(parts)
            if kind == "id" and in_article:
                if tag in CONTAINERS and whole in FURNITURE_WORDS:
                    return CERTAIN
                continue
            if whole in CHROME_WORDS and not (in_article and whole in OWN_WORDS):
                return CERTAIN
            if kind == "class" and (FURNITURE_WORDS.intersection(parts) or any(x in a and y in b or x in b and y in a for x, y in zip(parts, parts[1:], strict=False) for a, b in PAIRED.items())):
                return CERTAIN
            if CHROME_WORDS.intersection(parts) or any(x + y in CHROME_WORDS for x, y in zip(parts, parts[1:], strict=False)):
                found = DOUBTFUL
    return found


class _Scanner:
    """Tags of a page in order.  Time is linear in the page, whatever its markup: what has failed to end once is not tried for ever."""

    def __init__(self, page: str):
        self.page, self.at = page, 0
        self.ends: dict[int, int] = {}  # where a tag ends whose next quote or bracket stands at a place, or -1

    def __iter__(self) -> Iterator[tuple[str, str, bool, str]]:
        """``(text before, element, whether it ends, attributes)``; the element is empty for comments and the like.  The rest is ``page[at:]``."""
        page, seek = self.page, 0
        while (lt := page.find("<", seek)) >= 0:
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                yield self._take(lt, len(page) if end < 0 else end + 3), "", False, ""
            elif page.startswith("<![CDATA[", lt):
                end = page.find("]]>", lt + 9)
                yield self._take(lt, len(page) if end < 0 else end + 3), "", False, ""
            elif page.startswith(("<!", "<?"), lt) or NAME.match(page, lt + 1):
                m = NAME.match(page, lt + 1)
                end = self._end(m.end() if m else lt + 2, m is not None)
                if end < 0:
                    return  # no tag ends any more: the rest is text
                if m:
                    yield self._take(lt, end + 1), m[2].lower(), bool(m[1]), page[m.end() : end]
                else:
                    yield self._take(lt, end + 1), "", False, ""
            else:
                seek = lt + 1
                continue
            seek = self.at

    def _take(self, lt: int, to: int) -> str:
        text = self.page[self.at : lt]
        self.at = to
        return text

    def _end(self, at: int, quoted: bool) -> int:
        """Where the tag whose attributes begin at ``at`` ends; a ``>`` in quotes doesn't end it unless the quotes are never closed.

        What follows a place outside of quotes is the same for every tag that gets there, so each place is looked at once.
        """
        seen, pos, found = [], at, -1
        while quoted:
            m = QUOTES.search(self.page, pos)
            if m is None:
                break
            if m.start() in self.ends:
                found = self.ends[m.start()]
                break
            if m[0] == ">":
                found = m.start()
                break
            seen.append(m.start())
            pos = self.page.find(m[0], m.end()) + 1
            if not pos:
                break
        self.ends.update(dict.fromkeys(seen, found))
        return found if found >= 0 else self.page.find(">", at)

    def skip(self, tag: str) -> None:
        """Go on behind the end of a raw element."""
        shut = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(self.page, self.at)
        self.at = shut.end() if shut else len(self.page)


class _Stack:
    """Open elements ``(element, label inside it, whether a header made it chrome, whether it is doubtful)``, with where each name is open."""

    def __init__(self) -> None:
        self.items: list[tuple[str, int, bool, bool]] = []
        self.where: dict[str, list[int]] = {}
        self.headings = 0

    def push(self, tag: str, label: int, headed: bool, doubtful: bool) -> None:
        self.where.setdefault(tag, []).append(len(self.items))
        self.items.append((tag, label, headed, doubtful))
        self.headings += tag in HEADINGS

    def last(self, tag: str) -> int:
        """Position of the innermost open ``tag``, or -1."""
        at = self.where.get(tag)
        return at[-1] if at else -1

    def cut(self, at: int) -> None:
        while len(self.items) > at:
            tag = self.items.pop()[0]
            self.where[tag].pop()
            self.headings -= tag in HEADINGS

    def top(self) -> tuple[str, int, bool, bool]:
        return self.items[-1] if self.items else ("", PLAIN, False, False)


def blocks(page: str) -> list[tuple[int, str, bool]]:
    """Labelled blocks of a page in order: ``(PLAIN | ARTICLE | MAIN | CHROME | WRAPPED, text, whether it is doubtful)``, no text empty."""
    out: list[tuple[int, str, bool]] = []
    scanner, stack, parts = _Scanner(page), _Stack(), []
    inline_from = 0  # where in the stack the inline elements of the innermost block begin

    def close() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            _, label, headed, doubtful = stack.top()
            out.append((ARTICLE if label == CHROME and headed and stack.headings else label, text, doubtful))

    for text, tag, ends, rest in scanner:
        if text:
            parts.append(entities.unescape(text))
        if not tag:
            continue
        if tag in RAW:
            if not ends and not (tag == "svg" and rest.endswith("/")):
                scanner.skip(tag)
            continue
        if tag in VOID and tag != "hr":
            parts.append("" if tag == "wbr" else " ")
            continue
        _, outer, headed, doubtful = stack.top()
        if tag in INLINE:
            # only an inline element that is furniture itself matters, with those of its name inside it
            if ends:
                at_tag = stack.last(tag)
                if at_tag < inline_from:
                    continue
                if at_tag == inline_from:
                    close()
                stack.cut(at_tag)
            else:
                furniture = MARKED.search(rest) is not None and _furniture(tag, _attributes(rest), outer in (ARTICLE, WRAPPED)) == CERTAIN
                if not furniture and inline_from >= len(stack.items):
                    continue
                if furniture and outer != CHROME:
                    close()
                stack.push(tag, CHROME if furniture else outer, headed, doubtful)
            continue
        close()
        if ends:
            at_tag = stack.last(tag)
            if at_tag >= 0:
                stack.cut(at_tag)
                inline_from = min(inline_from, len(stack.items))
            continue
        if inline_from and stack.items[inline_from - 1][0] in ("p", "li" if tag == "li" else "p"):
            stack.cut(inline_from - 1)  # a new block ends an open paragraph and what is inline in it
        if tag not in VOID:
            attrs = _attributes(rest) if rest.strip() else {}
            _, outer, headed, doubtful = stack.top()
            is_main = tag == "main" or attrs.get("role", "").lower() == "main"
            if outer == CHROME:
                if tag == "article" and stack.last("article") < 0:
                    outer, headed, doubtful = WRAPPED, False, False
                elif is_main and tag != "article" and stack.last("article") < 0:  # a form or a badly named wrapper round the whole page
                    outer, headed, doubtful = MAIN, False, False
            elif tag == "article":
                outer, doubtful = (CHROME if outer in (ARTICLE, WRAPPED) else ARTICLE), False  # one inside another is a reader's comment
            elif outer == PLAIN and is_main:
                outer, doubtful = MAIN, False
            else:
                kind = _furniture(tag, attrs, outer in (ARTICLE, WRAPPED))
                if kind == CERTAIN:
                    outer, headed = CHROME, outer == ARTICLE and tag == "header"
                doubtful = doubtful or kind == DOUBTFUL
            stack.push(tag, outer, headed, doubtful)
        inline_from = len(stack.items)
    parts.append(entities.unescape(page[scanner.at :]))
    close()
    return out


def settle(found: list[tuple[int, str, bool]], repeated: list[float]) -> str | None:
    """Main text of labelled blocks, ``repeated`` giving the share of each that its host repeats; None if it is in the unique runs of the open ones."""
    kept = [(label, text, r) for (label, text, doubtful), r in zip(found, repeated, strict=True) if not (doubtful and r >= 0.5)]
    unique = lambda label: sum(len(t.split()) * (1 - r) for x, t, r in kept if x == label)
    labels = {x[0] for x in kept}
    best = next((k for k in (ARTICLE, WRAPPED, MAIN) if k in labels), PLAIN)
    size = sum(len(t.split()) for x, t, _ in kept if x == best)
    if best != PLAIN and size < SHORT:
        other = max((MAIN, PLAIN), key=unique)
        if other != best and unique(other) >= TIMES * max(size, 1):
            best = other
    return None if best == PLAIN else "\n\n".join(t for x, t, _ in kept if x == best)


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages -> main text where no repeat can change it, or else null; labels of all blocks, and the texts of those that are searched."""
    for pdf in batches:
        for k in range(0, len(pdf), 256):
            part = pdf.iloc[k : k + 256]
            texts, stream, rest, labels, doubts, hosts, ident = [], [], [], [], [], [], []
            for url, page in zip(part["url"], part["html"], strict=True):
                found = blocks(page) if isinstance(page, str) else []
                searched = [b[2] or b[0] not in (ARTICLE, WRAPPED, MAIN) for b in found]
                ident.append(int.from_bytes(hashlib.blake2b("\n".join(b[1] for b in found).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True))
                stream.append([b[1] for b, x in zip(found, searched, strict=True) if x])
                # repeats matter to doubtful blocks and to open ones
                clear = not any(b[0] == PLAIN or (b[2] and b[0] != CHROME) for b in found)
                texts.append((settle(found, [0.0] * len(found)) or "") if clear else None)
                rest.append([] if clear else [b[1] for b, x in zip(found, searched, strict=True) if not x])
                labels.append([] if clear else [b[0] for b in found])
                doubts.append([] if clear else [b[2] for b in found])
                m = HOST.match(url) if isinstance(url, str) else None
                hosts.append(m[1].lower() if m else "")
            yield pd.DataFrame({"page_id": part["page_id"].array, "url": part["url"].array, "host": hosts, "ident": ident, "text": texts, "outside": stream, "rest": rest, "labels": labels, "doubts": doubts})


def _suffixes(length: int):
    """Streams -> ``(bucket, page)``: each suffix's first ``length`` tokens with its host, and the page's identity."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw, ident = [" ".join(x).encode("utf-8", "surrogatepass") for x in pdf["outside"]], pdf["ident"].to_numpy()
            keys, offsets = words(raw)
            salt = words([h.encode() or b"-" for h in pdf["host"]])[0]
            grams = _grams(keys, length)
            buckets, pages = [], []
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                if b - a >= length:
                    buckets.append(np.unique(mix(grams[a : b - length + 1] ^ salt[i])))
                    pages.append(np.full(len(buckets[-1]), ident[i]))
            if buckets:
                yield pd.DataFrame({"bucket": np.concatenate(buckets).astype(np.int64), "page": np.concatenate(pages)})

    return run


def _grams(keys: np.ndarray, length: int) -> np.ndarray:
    out = keys[: max(0, len(keys) - length + 1)]
    for j in range(1, length):
        out = mix(out * U(0x9FB21C651E98DF25) + keys[j : len(keys) - length + 1 + j])
    return out


def _unique_runs(length: int):
    """Pages with the set of their repeated buckets -> main text, by what no repeat covers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for host, outside, rest, labels, doubts, repeated in zip(pdf["host"], pdf["outside"], pdf["rest"], pdf["labels"], pdf["doubts"], pdf["repeated"], strict=True):
                keys = words([" ".join(outside).encode("utf-8", "surrogatepass")])[0]
                covered = np.zeros(len(keys) + 1, np.int64)
                if repeated is not None and len(repeated) and len(keys) >= length:
                    salt = words([host.encode() or b"-"])[0][0]
                    hit = np.isin(mix(_grams(keys, length) ^ salt).astype(np.int64), np.asarray(repeated, np.int64))
                    at = np.flatnonzero(hit)
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + length, -1)
                keep = np.cumsum(covered)[:-1] == 0
                streamed, others, at = iter(outside), iter(rest), 0
                found, shares, runs = [], [], []
                for label, doubtful in zip(labels, doubts, strict=True):
                    if not doubtful and label in (ARTICLE, WRAPPED, MAIN):
                        found.append((label, next(others), False))
                        shares.append(0.0)
                        continue
                    text = next(streamed)
                    n = len(words([text.encode("utf-8", "surrogatepass")])[0])
                    mask, at = keep[at : at + n], at + n
                    found.append((label, text, doubtful))
                    shares.append(1.0 - float(mask.mean()) if n else 0.0)
                    if label == PLAIN and mask.any() and not (doubtful and shares[-1] >= 0.5):
                        runs.append(text if mask.all() else " ".join(w for w, k in zip(re.findall(r"[^\x20\x09-\x0D]+", text), mask, strict=True) if k))
                text = settle(found, shares)
                out.append("\n\n".join(runs) if text is None else text)
            yield pd.DataFrame({"page_id": pdf["page_id"].array, "url": pdf["url"].array, "text": out})

    return run


def split_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, host, ident, text, outside, rest, labels, doubts`` of every page: see ``_split``."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInPandas(_split, "page_id bigint, url string, host string, ident bigint, text string, outside array<string>, rest array<string>, labels array<int>, doubts array<boolean>")


def repeated_buckets(split: DataFrame, min_tokens: int = 6, min_pages: int = 2) -> DataFrame:
    """``bucket``: first tokens of suffixes that ``min_pages`` or more distinct pages of one host share."""
    suffixes = split.select("host", "ident", "outside").mapInPandas(_suffixes(min_tokens), "bucket bigint, page bigint")
    if min_pages == 2:  # whether there is another page needs only the extremes
        some = suffixes.groupBy("bucket").agg(F.min("page").alias("a"), F.max("page").alias("b"))
        return some.where("a < b").select("bucket")
    return suffixes.distinct().groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("bucket")


def extract_main(pages: DataFrame, *, min_tokens: int = 6, min_pages: int = 2) -> DataFrame:
    """Main text of ``pages(page_id, url, html)``: ``page_id, url, text, n_chars``, a row for every row.

    Character references are decoded, white space inside a block becomes one space, blocks are trimmed
    and joined in page order by two line feeds.  Which blocks they are is told at the head of this module.  A
    null, blank or chrome-only page has empty text.  Pages with equal blocks count as one page, so that
    copies and repeated rows don't turn each other's text into boilerplate.  A null or odd url is a host of its own.
    Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    split = Stored(split_pages(pages).withColumn("row", F.monotonically_increasing_id()), "pages", "zstd").df
    direct = split.where("text is not null").select("page_id", "url", "text")
    rest = split.where("text is null")
    # stored, so that the join below is of two plain shuffles and a bucket that very many pages share can be split
    repeated = Stored(repeated_buckets(split, min_tokens, min_pages), "repeated").df
    # which of its buckets repeat, for the pages that structure doesn't settle
    own = rest.select("row", "host", "outside").mapInPandas(_row_buckets(min_tokens), "row bigint, bucket bigint")
    marks = own.join(repeated, "bucket").groupBy("row").agg(F.collect_set("bucket").alias("repeated"))
    settled = rest.join(marks, "row", "left").select("page_id", "url", "host", "outside", "rest", "labels", "doubts", "repeated")
    out = direct.union(settled.mapInPandas(_unique_runs(min_tokens), "page_id bigint, url string, text string"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))


def _row_buckets(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row, host, outside in zip(pdf["row"], pdf["host"], pdf["outside"], strict=True):
                keys = words([" ".join(outside).encode("utf-8", "surrogatepass")])[0]
                if len(keys) >= length:
                    salt = words([host.encode() or b"-"])[0][0]
                    found = np.unique(mix(_grams(keys, length) ^ salt)).astype(np.int64)
                    yield pd.DataFrame({"row": np.full(len(found), row), "bucket": found})

    return run
