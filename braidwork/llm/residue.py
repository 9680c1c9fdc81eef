"""Template residue, filler and error-page text in posts.

Each post is reduced to its author's own text, and what it cites in quotation
marks is taken out. Unresolved slots and filler are looked for in every post
by itself. Sentences and lines become messages, with numbers (but for status
numbers), codes and addresses masked; equal messages are counted once, and the
distinct ones are mined for templates with a prefix tree: a leaf is a number of
tokens, the first TREE_DEPTH tokens and the kinds of evidence in the message,
and holds templates that a message joins if SIMILAR of its tokens agree. A leaf
of LEAF templates hands further ones to leaves below it, by the next token. A
template is classified once, by its evidence (``evidence``), and its verdict
goes to all posts that hold a message of it. Messages without any phrase or
shape that a case must have are dropped where they are read.

Skew: equal messages are merged with partial aggregation before they move, so
a text reposted by a third of all rows costs one message; a leaf keeps its
templates, not its messages, and compares a message with LEAF templates a level.

Defined results: null and empty posts, and posts that are all quotation, code
or signature, are no cases; repeated rows are judged alike; rows with a null
id come out with null; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import evidence
from braidwork.llm.posts import own_text
from braidwork.plans.columns import take
from braidwork.plans.lineage import written

TREE_DEPTH, SIMILAR, LEAF = 3, 0.6, 64

# Citations --------------------------------------------------------------------------
_CITED = re.compile(
    r"['\"„“«‹]\s?\{[^{}\n]*\}?\s?['\"“”»›](?!\w)|\"[^\"\n]{2,}\"|„[^“”\n]{2,}[“”]|“[^”\n]{2,}”|«[^»\n]{2,}»|(?<![\w'])'(?:[^'\n]|(?<=\w)'(?=\w)){6,}'(?!\w)"
)

# Unresolved slots: fixed values. Notations of template languages, and phrases that ask to be replaced.
_NAME = r"[A-Za-z_][A-Za-z0-9_.]*"
_SLOT_WORDS = (
    "name city date year link url subject title author board message recipient user site thread topic order product email address company phone "
    "name stadt datum ort jahr betreff anrede firma empfänger nom ville objet sujet lien année nombre ciudad fecha asunto enlace año".split()
)
_SLOT_PHRASE = (
    r"(?:(?:your|ihre?|dein|votre|ton|su|tu)\s[\w ]{2,30}|(?:insert|enter|add|insérer|insertar|inserte)\s[\w ]{2,30}|[\w ]{2,30}\s(?:goes\shere|here|hier\seinfügen|einfügen|eintragen|ici|aquí)"
    r"|link\sto\s\w{2,20}|" + "|".join(sorted(set(_SLOT_WORDS))) + ")"
)
_SLOT = re.compile(
    "|".join(
        [
            r"\{\{\{?\s*" + _NAME + r"(?:\s*\|\s*\w+)?\s*\}?\}\}",
            r"\{%[-\s]*" + _NAME + r"[-\s]*%\}",
            r"<%[=-]?\s*" + _NAME + r"\s*-?%>",
            r"[$#]\{" + _NAME + r"\}",
            r"%\(" + _NAME + r"\)[sd]",
            r"(?<![\w%])%[A-Za-z]\w*[A-Za-z]%(?![\w%])",
            r"@@\w+@@|##[A-Za-z]\w*##|\[\[" + _NAME + r"\]\]|(?<!\w)__[A-Z][A-Z_]+[A-Z]__(?!\w)",
            r"(?<![\w{$%])\{[A-Za-z][A-Za-z_.]+\}(?!\})",
            r"\[(?!(?:QUOTE|CODE|URL|IMG|SIZE|COLOR|LIST|SPOILER|EDIT|SOLVED)\])[A-Z]{2,}(?:_[A-Z]+)*\](?!\()|(?<!\w)\[[a-z]+(?:[_.][a-z]+)+\]",
            r"(?i:\[" + _SLOT_PHRASE + r"\]|<" + _SLOT_PHRASE + r">|\(" + _SLOT_PHRASE + r"\s?(?:\.\.\.|…)\))",
        ]
    )
)

# Filler: fixed values. -----------------------------------------------------------------
_FUNCTION_WORDS = frozenset(
    """a an the of to in is it that for on with was as at by this be are not but have from or one had what all were when we there can your which their if do will each
    how up out them then she many some so these would into has more two him see no than been who its now my over did down only way could my i you he they me our us about after again
    und der die das den dem des ein eine einen einem einer ist war nicht auf mit für von zu im am es ich du er sie wir ihr aber auch als wenn weil nach bei noch nur so wie hat haben sind wird wurde
    le la les un une des du de et est pas que qui dans pour sur avec sans ne se ce il elle nous vous je tu mon ma mes ton son sa ses plus mais ou où au aux par cela été a même si leur l d j c s n m qu ai eu puis deux très bien
    el los las una y es no se lo su sus por con para como más pero o ya al del mi me te ha he hay este esta esto sin sobre entre cuando muy""".split()
)
_FILLER_LINE = re.compile(
    r"(?i)^\W*(?:your (?:text|content|title|message) (?:goes )?here|(?:sample|dummy|placeholder|example) (?:text|content)|replace this (?:text|paragraph|sentence)\b.*|(?:body )?(?:copy|text|content) (?:to follow|to come|coming soon)|coming soon|under construction"
    r"|(?:content|text|copy) pending|tbd|to be (?:done|written|determined)"
    r"|(?:muster|blind|platzhalter|beispiel|füll)text(?:,? bitte ersetzen)?|hier steht (?:später|bald) (?:ein )?text|(?:text|inhalt) folgt(?: in kürze)?|platzhalter|hier (?:kommt|folgt) (?:ihr|der) text"
    r"|contenu à venir|texte à venir|faux texte|texte? (?:d'exemple|de remplissage)|votre texte ici|(?:votre|le) texte (?:va|vient|ira) ici|texte à remplacer\b.*|remplacez ce (?:texte|paragraphe)\b.*"
    r"|aquí va (?:su|tu|el) texto|contenido pendiente|texto de (?:relleno|ejemplo|muestra)|(?:su|tu) texto aquí|próximamente|sustituya este (?:texto|párrafo)\b.*|reemplace este (?:texto|párrafo)\b.*)\W*$"
)
_LIST_LINE = re.compile(r"(?i)^\W*(?:item|bullet|heading|column|paragraph|section|title|line|row|cell|entry|element|eintrag|punkt|überschrift|spalte|absatz|élément|titre|colonne|paragraphe|puce|elemento|título|columna|párrafo|punto) (?:lorem|ipsum|here|one|two|three|text|title|\d+|hier|eins|text|titel|un|ici|texte|aquí|uno|texto)\W*$")
_LATIN = re.compile(r"(?i)\b(?:lorem|ipsum)\b")
_WORD = re.compile(r"[^\W\d_]+")
_KEYS = re.compile(r"(?i)(?:asdf|qwer|zxcv|hjkl|dfgh|jkl;|sdf|xxx|aaa|yuio|uiop|vbnm|ghjk|fghj|tyui|wert)")

def _triggers(words: str) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in words.split():
        a.add_word(w.replace("_", " "), True)
    a.make_automaton()
    return a


_FILLER_WORDS = _triggers("text title message sentence copy paragraph content contenu contenido soon tbd to_be_ platzhalter construction próximamente inhalt párrafo lorem ipsum")


def _any(a: ahocorasick.Automaton, text: str) -> bool:
    return next(a.iter(text), None) is not None


_SLOT_MARKS = re.compile(r"[{%@#\[<_$]|\((?=[^()\n]{2,40}(?:\.\.\.|…)\))")
_SPLIT = re.compile(r"\n+|(?<=[.!?…])\s+(?=[^\s\d])|(?<=\.\.\.)\s+|(?<=,)\s+(?=<)")
# (a quick test, what to mask, the mark)
_MASKS = [
    (re.compile(r"://|\.(?:example|com|org|net)\b"), re.compile(r"https?://\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:example|com|org|net)\b", re.I), "@"),
    (re.compile(r"/[\w.-]+/"), re.compile(r"(?:/[\w.-]+){2,}"), "/"),
    (re.compile(r"[0-9a-f]{6}"), re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b"), "#"),
    (re.compile(r"\d"), re.compile(r"(?<![\d.,:])[45]\d\d(?![\d%]|[.,:]\d)|(\d+(?:[.,:]\d+)*)"), lambda m: "#" if m[1] else m[0]),  # but for status numbers
]


def has_slot(text: str) -> bool:
    """Whether a field is left that software or author should have filled in."""
    at = _SLOT_MARKS.search(text)
    return at is not None and _SLOT.search(text, at.start()) is not None


def is_filler(text: str) -> bool:
    """Whether a paragraph or line is put in for lack of content."""
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    if len(lines) > 1 and sum(_LIST_LINE.match(x) is not None for x in lines if len(x) < 40) >= 2:
        return True
    cued = _any(_FILLER_WORDS, text.lower())
    for line in lines:
        words = line.lower().split()
        if cued or 4 <= len(words) and len(set(words)) == 1:
            for sentence in re.split(r"(?<=[.!?])\s+", line):
                if _FILLER_LINE.match(sentence):
                    return True
                said = [w.lower() for w in _WORD.findall(sentence)]
                if len(said) >= 4 and len(set(said)) == 1 or _LATIN.search(sentence) and len(said) >= 2 and sum(w in _FUNCTION_WORDS for w in said) * 8 < len(said):
                    return True
        if len(words) >= 4 and sum(map(_FUNCTION_WORDS.__contains__, words)) * 25 < len(words):
            said = _WORD.findall(line)
            if sum(len(m) for m in _KEYS.findall(line)) >= 0.8 * sum(map(len, words)):
                return True
            if len(said) >= 12 and sum(w.lower() in _FUNCTION_WORDS for w in said) * 25 < len(said) and sum(w[0].isupper() for w in said) * 4 < len(said) and not re.search(r"[@/=<>{}\[\]]|\d", line):
                return True
    return False


def _mask(message: str) -> str:
    for test, pattern, mark in _MASKS:
        if test.search(message):
            message = pattern.sub(mark, message)
    return message


def messages(own: str) -> list[str]:
    """Masked sentences and lines that may be cases."""
    if not evidence.promising(evidence.plain(own)):
        return []
    out = dict.fromkeys(" ".join(_mask(x).split()) for x in _SPLIT.split(own) if evidence.promising(evidence.plain(x)))
    return [x for x in out if x]


def _cited_out(own: str) -> str:
    return _CITED.sub(' "" ', own) if any(c in own for c in "\"'„“«") else own


def is_error(text: str) -> bool:
    """Whether a text alone shows an error, a refusal or a notice; what ``residue`` finds without merging templates."""
    return any(evidence.verdict(evidence.kinds_in(x)) for x in messages(_cited_out(own_text(text))))


_STATUS = re.compile(r"(?:^|[^'\"„“«‹\s])\s*[{](?:[^{}]+,\s*)?\W{0,2}(?:status|code|error)\W{1,4}\s*[45]\d\d\b")


def _read():
    def batches(it):
        for batch in it:
            alone, found = [], []
            for text in batch.column("text").to_pylist():
                own = own_text(text)
                status = "{" in own and _STATUS.search(own) is not None
                own = _cited_out(own)
                alone.append(bool(own) and (status or has_slot(own) or is_filler(own)))
                found.append([] if alone[-1] else messages(own))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(alone, pa.bool_()), pa.array(found, pa.list_(pa.string()))], names=["id", "alone", "messages"])

    return batches


def _kinds():
    def batches(it):
        for batch in it:
            bits = [evidence.kinds_in(x) for x in batch.column("message").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("message"), pa.array(bits, pa.int32())], names=["message", "kinds"])

    return batches


class _Leaf:
    """Templates of one place of the tree: their tokens and verdict."""

    def __init__(self, depth: int):
        self.depth, self.templates, self.below = depth, [], {}

    def judge(self, tokens: list[str], kinds: int) -> bool:
        best, most = None, SIMILAR
        for t in self.templates:
            like = sum(map(str.__eq__, t[0], tokens)) / len(tokens)
            if like >= most:
                best, most = t, like
                if like == 1:
                    break
        if best is not None:
            if most < 1:
                best[0] = [a if a == b else "*" for a, b in zip(best[0], tokens)]
            return best[1]
        if len(self.templates) < LEAF or self.depth >= len(tokens):
            self.templates.append([tokens, evidence.verdict(kinds)])
            return self.templates[-1][1]
        return self.below.setdefault(tokens[self.depth], _Leaf(self.depth + 1)).judge(tokens, kinds)


def _mine():
    """Messages sorted by leaf to the hashes of those whose template is a case."""

    def batches(it):
        at, leaf = None, _Leaf(TREE_DEPTH)
        for batch in it:
            out: list[int] = []
            for key, place, message, kinds in zip(*(batch.column(c).to_pylist() for c in ("key", "leaf", "message", "kinds"))):
                if place != at:
                    at, leaf = place, _Leaf(TREE_DEPTH)
                if leaf.judge(message.split(" "), kinds):
                    out.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["key"])

    return batches


def residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, reason) of the posts that hold residue: ``alone`` for a slot or filler, ``template`` for an error or notice."""
    read = written(take(df, id=key, text=text).mapInArrow(_read(), f"id {dict(df.dtypes)[key]}, alone boolean, messages array<string>"), "posts")
    pairs = read.where("not alone").select("id", F.explode("messages").alias("message"))
    tokens = F.split("message", " ")
    distinct = pairs.select("message").distinct().mapInArrow(_kinds(), "message string, kinds int")
    leaves = distinct.select(F.xxhash64("message").alias("key"), F.concat_ws(" ", F.size(tokens).cast("string"), F.col("kinds").cast("string"), F.slice(tokens, 1, TREE_DEPTH)).alias("leaf"), "message", "kinds")
    cases = leaves.repartition("leaf").sortWithinPartitions("leaf", "message").mapInArrow(_mine(), "key long")
    by_template = pairs.select("id", F.xxhash64("message").alias("key")).join(cases, "key", "left_semi").select("id").distinct()
    alone = read.where("alone").select("id", F.lit("alone").alias("reason"))
    return alone.unionByName(by_template.withColumn("reason", F.lit("template"))).withColumnRenamed("id", key)
