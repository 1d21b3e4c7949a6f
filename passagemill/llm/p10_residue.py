"""Problem 10: template residue, filler and error pages in place of content.

Method: labelled exemplars are retrieved through an inverted index from words to exemplars; a window (a sentence, a line, or
the rest of one) is scored by TF-IDF containment, both of the window in the exemplar and of the exemplar in the window. Word
weights come from document frequencies over all documents. A document is a case if residue covers it: it has residue windows
and next to no other sentence, menus and footers aside. Or if a placeholder stands in it outside a window that explains it:
every placeholder spelling becomes one slot word, and a window that contains most of an explaining exemplar is excused.

Null and empty texts are no case. Texts of any length are read whole. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

SLOT = "slotslot"
#: Labelled exemplars. 0 stands for any number, h for any hexadecimal id, w for any quoted word.
RESIDUE = """404 Not Found
The requested page was not found on this server
403 Forbidden
Error 403: you do not have access to this page
Access denied
500 Internal Server Error
The server met an unexpected condition. Reference h
502 Bad Gateway
503 Service Unavailable
proxy 0.0.0
Request h at 0:0
Request timed out after 0 ms. Reload
Oops! Something went wrong on our side
Please try again later
We can't find what you are looking for
It may have moved or been deleted
This page is down for maintenance
We will be back at 0:0
The page you asked for does not exist on
The item has been removed by its owner
Your session has expired
Sign in again to go on
No results
Check the spelling and search again
Too many requests from your network
Wait 0 seconds and retry. Ray h
Turn it on in your settings and reload
অনুগ্রহ করে পরে আবার চেষ্টা করুন
इस पृष्ठ को देखने के लिए जावास्क्रिप्ट चालू करें
Rendering of block h failed
Traceback: KeyError w at line 0
Fatal error: call to undefined function render w in srv w page.inc on line 0
Warning: could not connect to the database w prod code 0
Checking that you are not a robot
This takes a few seconds. Id h
Type the letters you see in the picture to go on
Cookies are switched off
Switch them on to continue to
Your browser is out of date and cannot show
Please enable JavaScript to view this page
This app needs JavaScript to run
noscript: content is shown only with scripts on
Scripts are blocked
You need them to read this answer
Loading Loading If nothing appears, allow scripts
If nothing appears allow scripts
पृष्ठ नहीं मिला
आप जो पृष्ठ खोज रहे हैं वह मौजूद नहीं है
इस पृष्ठ को देखने के लिए जावास्क्रिप्ट सक्षम करें
पान सापडले नाही
कृपया नंतर प्रयत्न करा
এই পৃষ্ঠা দেখতে জাভাস্ক্রিপ্ট চালু করুন
পৃষ্ঠাটি পাওয়া যায়নি
இந்தப் பக்கத்தைக் காண ஜாவாஸ்கிரிப்டை இயக்கவும்
பக்கம் கிடைக்கவில்லை பிழை 0
ఈ పేజీ చూడటానికి జావాస్క్రిప్ట్ను ప్రారంభించండి
పేజీ కనబడలేదు లోపం 0
یہ صفحہ دیکھنے کے لیے جاوا اسکرپٹ فعال کریں
صفحہ نہیں ملا
براہ کرم دوبارہ کوشش کریں
null undefined NaN None n/a object Object Title: null
xxx xxx xxx
Your text goes here
Heading text
Coming soon
Insert answer
asdf qwer asdf zxcv
Write a short description of the passage here
This is sample text, replace it with your own
Test test test
Example paragraph
Blah blah blah
Nothing here yet
यहाँ अपना पाठ लिखें
এখানে আপনার লেখা দিন
உங்கள் உரை இங்கே
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua molor deser quorem irure animo labor erunt ultro nullo magnis sitem velunt ebore tantis adipis pariat commod culpis veliq fugit""".split("\n")
#: Windows that explain or quote such things, or notices that belong to one part of a page.
EXPLAINING = f"""manual explains that a mark such as {SLOT} is replaced by the heading before the page is sent so no reader of the sees it
The setting {SLOT} names the folder of the user wrote the clerk in the guide to the
Square brackets such as {SLOT} mark what the scribe of could not read on the
for example {SLOT} stands for the value and is explained as a placeholder variable
When a reader in met error 404 the office learned that an address had no page behind it
A 500 error means that the server failed while 403 means that access is refused the team tells them apart with a checklist
Printers in set lorem ipsum while they waited for the article a habit the workshop kept until 0
The sign beneath the read page not found an old joke of the librarian who kept 0 loose sheets
JavaScript runs in the browser and a in used it for 0 years to draw its charts
Please enable JavaScript to post a comment
Error the comments could not be loaded
Video unavailable in your browser
Sign in with cookies enabled to vote""".split("\n")
#: Lines around content that are neither content nor residue.
AROUND = """Sign up for our weekly letter and never miss an update
Reproduction without written consent is prohibited
All rights reserved
We use cookies to improve your visit. By continuing you accept our cookie policy
This site stores small files on your device. Manage choices
Get the app for faster answers. Free on every store
Powered by pages release 0
Last edited by user0 Report a problem""".split("\n")
#: The spellings of a placeholder.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,60}%\}|[$#]\{[^{}\n]{1,60}\}|\{[A-Za-z_][A-Za-z_.]{0,40}\}|\{\d{1,2}\}|<%[^%\n]{0,60}%>|<<[^<>\n]{1,60}>>|<(?:your|insert|enter)[ _][^<>\n]{1,40}>|@@\w{1,40}@@|\[\[[^\[\]\n]{1,60}\]\]"
    r"|__[A-Z][A-Z0-9_]*?__|%[A-Z][A-Z_]+%|%\([a-z_]+\)[sd]|\[(?:INSERT|TODO|ENTER|YOUR)\b[^\[\]\n]{0,60}\]|\[(?!object\b)[a-z][a-z_ ]{1,30}\]|\b\w+_PLACEHOLDER\b|\bPLACEHOLDER_\w+"
)
MARK = re.compile(r"[{%<\[@_]")
HEX = re.compile(r"\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{6,}\b")
NUMBER = re.compile(r"\d+")
WINDOW = re.compile(r"\n+|(?<=[.!?।॥۔؟])[\s]+")
BREAK = re.compile(r"[\s.,;:!?/|·()\[\]{}<>\"'“”‘’«»—–\-_=*#%@।॥۔؟،…©›»•+]+")
SENTENCE_END = ".!?।॥۔؟"
#: A window is an exemplar's if it holds COVERED of the exemplar's weight, which is HELD of its own, or if ONLY of its own weight is the exemplar's.
BAGS = {"undefined", "lorem"}
COVERED, HELD, ONLY = 0.75, 0.45, 0.85
#: A sentence has REAL_WORDS words; a page of residue has at most REAL_SHARE as many words in other sentences.
REAL_WORDS, REAL_SHARE = 5, 0.35


def window_words(window: str) -> list[str]:
    """Words of a window; numbers are 0, hexadecimal ids h."""
    return [w for w in BREAK.split(NUMBER.sub("0", HEX.sub("h", window.lower().replace("‌", "").replace("‍", "")))) if w]


class Exemplars:
    """Inverted index from words to labelled exemplars, with weights by document frequency."""

    def __init__(self, df: dict[str, int], n: int):
        self.texts = [(0, x) for x in RESIDUE] + [(1, x) for x in EXPLAINING] + [(2, x) for x in AROUND]
        self.kinds = [k for k, _ in self.texts]
        self.sets = [set(window_words(x)) for _, x in self.texts]
        self.unknown = math.log(1 + n)
        self.idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 0.1 for s in self.sets for w in s}
        self.total = [sum(self.idf[w] for w in s) for s in self.sets]
        self.residue = {w for k, s in zip(self.kinds, self.sets) if k == 0 for w in s}
        self.index = defaultdict(list)
        for i, s in enumerate(self.sets):
            for w in s:
                self.index[w].append(i)
        # every residue exemplar that a window holds to COVERED has one of its heaviest words there; lists of fillers may come in part
        self.trigger = set()
        for k, s in zip(self.kinds, self.sets):
            if k == 0:
                telling = [w for w in sorted(s - {"0", "h", "w"}, key=lambda w: -self.idf[w]) if self.idf[w] > 3.5] or list(s)
                self.trigger |= set(telling[: 99 if s & BAGS else 3])

    def label(self, words: list[str]) -> int | None:
        """0 residue, 1 explained, 2 around, None other: the exemplar of the highest containment."""
        distinct = set(words)
        score: dict[int, float] = defaultdict(float)
        for w in distinct:
            for i in self.index.get(w, ()):
                score[i] += self.idf[w]
        if not score:
            return None
        whole = sum(self.idf.get(w, 6.0) for w in distinct)
        best, kind = 0.0, None
        if sum(self.idf[w] for w in distinct if w in self.residue) >= 0.9 * whole:  # several exemplars in one line
            best, kind = 1.0, 0
        for i, s in score.items():
            held, covered = s / whole, s / self.total[i]
            k = self.kinds[i]
            ok = held >= ONLY or covered >= COVERED and held >= HELD if k != 1 else covered >= 0.6 and held >= 0.25
            if ok and (both := held + covered) > best:
                best, kind = both, k
        return kind


def vocabulary() -> set[str]:
    return {w for x in RESIDUE + EXPLAINING + AROUND for w in window_words(x)}


def frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many documents each exemplar word occurs, over all documents; at most one row per exemplar word and task reaches the shuffle."""
    vocab = vocabulary()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                c[""] += 1
                if t:
                    c.update(vocab.intersection(BREAK.sub(" ", t.lower()).split()))
        yield pd.DataFrame({"word": pd.Series(list(c), dtype="object"), "n": pd.Series(list(c.values()), dtype="int64")})

    rows = docs.select("text").mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r.word: r.n for r in rows}
    return df, df.pop("", 0)


def is_sentence(window: str, w: list[str]) -> bool:
    return len(w) >= REAL_WORDS and (window.rstrip(" \r\t\"'”’»)")[-1:] in SENTENCE_END or len(w) >= 9) and not ("|" in window or " · " in window or " / " in window or "  " in window)


def judge(text: str | None, ex: Exemplars) -> tuple[bool, int, int, int]:
    """Whether the text is a case, and its unexplained slots, residue words and words of real sentences."""
    slots = residue = real = 0
    if not text:
        return False, 0, 0, 0
    text = text.replace("\u200c", "").replace("\u200d", "")
    has_slot = MARK.search(text) is not None and PLACEHOLDER.search(text) is not None
    if has_slot:
        text = PLACEHOLDER.sub(f" {SLOT} ", text)
    elif ex.trigger.isdisjoint(BREAK.sub(" ", text.lower()).split()):
        return False, 0, 0, 0
    others = []
    for window in WINDOW.split(text):
        if not window or window.isspace():
            continue
        w = window_words(window)
        if ex.trigger.isdisjoint(w) and SLOT not in w:
            others.append((window, w))
            continue
        kind = ex.label(w)
        if SLOT in w and kind != 1:
            slots += w.count(SLOT)
        if kind == 0:
            residue += len(w)
        elif kind == 1:
            real += len(w) if len(w) > 8 else 0
        elif kind is None:
            others.append((window, w))
    if residue:  # else it doesn't matter what the rest is
        real += sum(len(w) for window, w in others if is_sentence(window, w) and ex.label(w) is None)
    return slots > 0 or residue > 0 and real <= REAL_SHARE * residue, slots, residue, real


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, is_case, slots, residue_words, real_words of every document."""
    df, n = frequencies(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ex = Exemplars(df, n)
        for b in batches:
            r = [judge(t, ex) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "is_case": [x[0] for x in r], "slots": [x[1] for x in r], "residue_words": [x[2] for x in r], "real_words": [x[3] for x in r]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id bigint, is_case boolean, slots int, residue_words int, real_words int")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).filter("is_case").select("doc_id")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
