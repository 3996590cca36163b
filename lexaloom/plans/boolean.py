"""Boolean keyword queries: text -> tokens -> postfix -> expression -> DataFrame.

`&&` or a blank is AND, `||` OR, `!` NOT, with parentheses; NOT binds tightest.
Terms go through the same alphabet and stemmer as documents. What no query can
mean (an operator without its operand) matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN_PATTERN, stem_word
from ..operators.index import Index, document_url

AND, OR, NOT, OPEN, CLOSE = "AND", "OR", "NOT", "(", ")"
_SYMBOLS = {"&&": AND, "||": OR, "!": NOT, "(": OPEN, ")": CLOSE}
_BINDING = {NOT: 3, AND: 2, OR: 1}
_SCANNER = re.compile(rf"(?P<blank>[ \t\r\n]+)|(?P<symbol>&&|\|\||[!()])|(?P<term>{TOKEN_PATTERN})|(?P<other>.)", re.DOTALL)


@dataclass(frozen=True)
class Term:
    text: str


Token = str | Term
Node = tuple  # (AND, a, b) | (OR, a, b) | (NOT, a) | (Term,)

PAGE_SIZE = 50


def scan(query: str, lenient: bool = False) -> list[Token]:
    """Infix tokens with implied ANDs.

    A character outside the language implies an AND too, for every byte of it,
    when it follows a term or a closing parenthesis; since no operand comes with it the query then
    matches nothing. lenient: such characters only separate terms."""
    out: list[Token] = []
    ended = False  # the last token was a term or a closing parenthesis

    def imply(times: int = 1) -> None:
        if ended:
            out.extend([AND] * times)

    for found in _SCANNER.finditer(query):
        kind, text = found.lastgroup, found[0]
        if kind == "term":
            imply()
            out.append(Term(stem_word(text.lower())))
            ended = True
        elif kind == "symbol":
            token = _SYMBOLS[text]
            if token in (OPEN, NOT):
                imply()
            out.append(token)
            ended = token == CLOSE
        elif kind == "other" and not lenient:
            imply(len(text.encode("utf-8", "surrogatepass")))
    return out


def postfix(tokens: Iterable[Token]) -> list[Token]:
    """Operators after their operands. Parentheses without a partner are ignored."""
    out: list[Token] = []
    waiting: list[str] = []
    for token in tokens:
        if isinstance(token, Term):
            out.append(token)
        elif token == OPEN:
            waiting.append(token)
        elif token == CLOSE:
            while waiting and waiting[-1] != OPEN:
                out.append(waiting.pop())
            if waiting:
                waiting.pop()
        else:
            firm = _BINDING[token] + (token == NOT)  # NOT groups from the right
            while waiting and waiting[-1] != OPEN and _BINDING[waiting[-1]] >= firm:
                out.append(waiting.pop())
            waiting.append(token)
    return out + [t for t in reversed(waiting) if t != OPEN]


def parse(query: str, lenient: bool = False) -> Node | None:
    """The expression of a query, None if it is empty or lacks operands."""
    stack: list[Node] = []
    for token in postfix(scan(query, lenient)):
        if isinstance(token, Term):
            stack.append((token,))
            continue
        n = 1 if token == NOT else 2
        if len(stack) < n:
            return None
        operands = stack[-n:]
        del stack[-n:]
        stack.append((token, *operands))
    return stack[0] if len(stack) == 1 else None


def terms_of(node: Node | None) -> list[str]:
    """Distinct terms in order of appearance."""
    if node is None:
        return []
    if isinstance(node[0], Term):
        return [node[0].text]
    return list(dict.fromkeys(t for child in node[1:] for t in terms_of(child)))


def fold(node: Node, term: Callable, both: Callable, either: Callable, negate: Callable):
    head = node[0]
    if isinstance(head, Term):
        return term(head.text)
    parts = [fold(child, term, both, either, negate) for child in node[1:]]
    return negate(parts[0]) if head == NOT else (both if head == AND else either)(*parts)


def matches_nothing_known(node: Node) -> bool:
    """Whether a document without any of the terms matches."""
    return fold(node, lambda t: False, lambda a, b: a and b, lambda a, b: a or b, lambda a: not a)


def hits(index: Index, query: str, lenient: bool = False) -> DataFrame:
    """(doc_id) of the documents that match.

    One pass over the postings of the query's terms makes a flag per term and
    document, however many operators there are. Only a query that documents
    without any of its terms match looks at all documents."""
    node = parse(query, lenient)
    if node is None:
        return index.docs.select("doc_id").limit(0)
    terms = terms_of(node)
    names = {t: f"has_{i}" for i, t in enumerate(terms)}
    flags = index.postings.where(F.col("term").isin(*terms)).groupBy("doc_id").agg(*[F.bool_or(F.col("term") == t).alias(name) for t, name in names.items()])
    if matches_nothing_known(node):
        flags = index.docs.select("doc_id").join(flags, "doc_id", "left").select("doc_id", *[F.coalesce(n, F.lit(False)).alias(n) for n in names.values()])
    condition: Column = fold(node, lambda t: F.col(names[t]), lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)
    return flags.where(condition).select("doc_id")


def hits_by_sets(index: Index, query: str, lenient: bool = False) -> DataFrame:
    """The same by set operations on lists of documents, operator by operator."""
    node = parse(query, lenient)
    if node is None:
        return index.docs.select("doc_id").limit(0)
    universe = index.docs.select("doc_id")
    return fold(
        node, lambda t: index.postings.where(F.col("term") == t).select("doc_id"),
        lambda a, b: a.intersect(b), lambda a, b: a.union(b).distinct(), lambda a: universe.subtract(a),
    )


def with_metadata(page: DataFrame, index: Index) -> DataFrame:
    """page_id, title and url of a page of hits; the join comes after the limit."""
    joined = page.join(index.docs, "doc_id")
    return joined.select(*page.columns, "page_id", "title", document_url(F.col("source_id"), F.col("page_id")).alias("url"))


def total(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"))


def search(index: Index, query: str, offset: int = 0, limit: int = PAGE_SIZE, lenient: bool = False) -> DataFrame:
    """(total, doc_id, page_id, title, url): one page of hits by ascending document number."""
    found = hits(index, query, lenient)
    page = found.orderBy("doc_id").offset(max(0, offset)).limit(max(0, limit))
    return with_metadata(page, index).select(total(found).scalar().alias("total"), "doc_id", "page_id", "title", "url")


def search_many(index: Index, queries: Sequence[str], offset: int = 0, limit: int = PAGE_SIZE, lenient: bool = False) -> DataFrame:
    """(query_id, total, doc_id, page_id, title, url) of every query that isn't
    blank; a query without hits on the page has one row of nulls beside its total. query_id is its place, from 0."""
    asked = [(i, q) for i, q in enumerate(queries) if q.strip(" \t\r\n")]
    pages = []
    for i, query in asked:
        found = hits(index, query, lenient)
        page = found.orderBy("doc_id").offset(max(0, offset)).limit(max(0, limit))
        head = total(found).select(F.lit(i).alias("query_id"), "total")
        rows = with_metadata(page, index).withColumn("of", F.lit(i))
        pages.append(head.join(rows, F.col("query_id") == F.col("of"), "left").drop("of"))
    if not pages:
        return index.docs.sparkSession.createDataFrame([], "query_id int, total long, doc_id int, page_id long, title string, url string")
    return reduce(DataFrame.unionByName, pages)


def format_results(rows: Iterable, total_hits: int, offset: int, limit: int) -> str:
    """A result page as tab-separated text behind a header line."""
    head = f"OK\ttotal={total_hits}\toffset={offset}\tlimit={limit}"
    return "\n".join([head, *(f"{r['doc_id']}\t{r['page_id']}\t{r['title']}\t{r['url']}" for r in rows)]) + "\n"


def page_offsets(offset: str | int | None, total_hits: int, size: int = PAGE_SIZE) -> tuple[int, int | None, int | None]:
    """The offset that a request means, and those of the pages before and after, None where there is none."""
    try:
        at = max(0, int(offset or 0))
    except ValueError:
        at = 0
    return at, max(0, at - size) if at > 0 else None, at + size if at + size < total_hits else None
