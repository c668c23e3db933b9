"""For each query the DuckDB SQL that gives the same rows.

Shared steps are CTEs; a query takes those it names, and those they name. Patterns are the package's
own, since both regular expression engines accept them; everything else is written anew in SQL.
"""

from __future__ import annotations

import re

from pagemill.functions import html as H
from pagemill.functions import text as T
from pagemill.functions import urls as U
from pagemill.operators import language as L
from pagemill.operators import links as K
from pagemill.operators.export import CSV_COLUMNS, CSV_HEADER, MESSAGE_LIMIT
from pagemill.plans import catalog as C
from pagemill.plans import fixtures as fx

_TAG_END = r"(?:[\s/>].*|\z)"
# For other elements, the tags that close them (by start or end; by end only).
ELEMENT_CLOSERS = {
    "td": ("td th tr tbody thead tfoot".split(), "table body html".split()),
    "th": ("td th tr tbody thead tfoot".split(), "table body html".split()),
    "li": (["li"], "ul ol body html".split()),
    "dt": ("dt dd".split(), "dl body html".split()),
    "dd": ("dt dd".split(), "dl body html".split()),
}
HEADINGS = "h1 h2 h3 h4 h5 h6".split()
SIMPLE_XPATH = re.compile(r"^//([A-Za-z][A-Za-z0-9]*)$")


def simple_tag(xpath: str) -> str | None:
    """Tag of an XPath of the form ``//tag``, else None."""
    found = SIMPLE_XPATH.match(xpath.strip())
    return found.group(1).lower() if found else None


def open_pattern(tag: str) -> str:
    return rf"(?is)<{tag}(?:[\s/][^>]*)?>"


def close_pattern(tag: str) -> str:
    """From the first tag that ends the element up to the end of the text."""
    if tag == "p":
        both, ends = H.PARAGRAPH_CLOSERS, []
    elif tag in HEADINGS:
        both, ends = HEADINGS, "article body div header html main section td".split()
    else:
        both, ends = ELEMENT_CLOSERS.get(tag, ([tag], ["body", "html"]))
    starts = rf"/?(?:{'|'.join(both)})"
    return rf"(?is)<(?:{starts}{'|/(?:' + '|'.join(ends) + ')' if ends else ''}){_TAG_END}"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def part(url: str, group: int) -> str:
    return f"regexp_extract({url}, {lit(U.URL_PATTERN)}, {group})"


def netloc(url: str) -> str:
    return part(url, 2)


def path(url: str) -> str:
    return f"regexp_replace({part(url, 3)}, ';[^/]*$', '')"


def filename(url: str) -> str:
    return f"replace({netloc(url)} || {path(url)}, '/', '_')"


def raw_name(url: str) -> str:
    p = path(url)
    return (
        f"replace(case when contains(regexp_extract({p}, '[^/]*$'), '.') then {p} "
        f"when ends_with({p}, '/') then {p} || 'index.html' else {p} || '/index.html' end, '/', '_')"
    )


def extension(url: str) -> str:
    return f"lower(regexp_extract({path(url)}, '[^/.][^/]*([.][^./]*)$', 1))"


def escapes(text: str, space: str) -> str:
    """One spelling of escapes: written ones are marked by "!" in the encoded text, pieces are then judged by themselves."""
    pieces = f"regexp_extract_all(regexp_replace(url_encode({text}), '%25([0-9A-Fa-f]{{2}})', '!\\1', 'g'), '[!%][0-9A-Fa-f]{{2}}|[^!%]+')"
    one = "url_decode('%' || substr(p, 2))"
    return (
        f"array_to_string(list_transform({pieces}, lambda p: case when not regexp_matches(p, '^[!%]') then p "
        f"when substr(p, 2) = '20' then '{space}' when not regexp_matches(p, '^.[2-7]') then '%' || upper(substr(p, 2)) "
        f"when regexp_matches({one}, '^[A-Za-z0-9._~-]$') then {one} "
        f"when p[1] = '%' and contains('!$&''()*+,;=:@/?[]#', {one}) then {one} else '%' || upper(substr(p, 2)) end), '')"
    )


def canonical(url: str) -> str:
    pair = r"(?s)^([^=]*)=?(.*)$"
    args = f"list_filter(string_split({escapes(part(url, 4), '+')}, '&'), lambda a: a <> '')"
    path = escapes(part(url, 3), "%20")
    pairs = (
        f"list_sort(list_transform({args}, lambda a: {{'k': regexp_extract(a, {lit(pair)}, 1), "
        f"'v': regexp_extract(a, {lit(pair)}, 2)}}))"
    )
    query = f"array_to_string(list_transform({pairs}, lambda s: s.k || '=' || s.v), '&')"
    return (
        f"lower({part(url, 1)}) || case when {netloc(url)} = '' then ':' else '://' || lower({netloc(url)}) end || "
        f"case when {part(url, 3)} = '' then '/' else {path} end || "
        f"case when coalesce({query}, '') = '' then '' else '?' || {query} end"
    )


def under(host: str, domain: str) -> str:
    return f"({host} <> '' and ({host} = {domain} or ends_with({host}, '.' || {domain})))"


def entities(text: str) -> str:
    names = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in sorted(H.ENTITIES.items())) + "}"
    name = f"regexp_extract(p, {lit(H.ENTITY_PATTERN)}, 1)"
    rest = f"substr(p, length({name}) + 2)"
    decoded = (
        f"case when {name} = '' then '&' || p when {name} = 'amp' then '&' || {rest} "
        f"when {name} = 'quot' then '\"' || {rest} when {name} = 'copy' then '©' || {rest} "
        f"when {name} = 'middot' then '·' || {rest} else coalesce({names}[{name}] || {rest}, '&' || p) end"
    )
    return (
        f"case when contains({text}, '&') then string_split({text}, '&')[1] || "
        f"array_to_string(list_transform(string_split({text}, '&')[2:], lambda p: {decoded}), '') "
        f"else {text} end"
    )


def without_tags(text: str) -> str:
    return f"regexp_replace({text}, {lit(H.TAG_PATTERN)}, '', 'g')"


def elements(source: str, xpath: str, idx: int, keep: str) -> str:
    """Rows (keep, xp_idx, pos, origin, content) of one ``//tag``."""
    tag = simple_tag(xpath)
    return f"""select {keep}, cast({idx} as integer) xp_idx, pos, {lit(xpath)} origin, content from (
      select {keep}, pos, {entities('raw')} content from (
        select {keep}, unnest(l) raw, cast(generate_subscripts(l, 1) - 1 as integer) pos from (
          select {keep}, list_transform(string_split_regex(v, {lit(open_pattern(tag))})[2:],
            lambda b: {without_tags(f"regexp_replace(b, {lit(close_pattern(tag))}, '')")}) l
          from {source})))
      where regexp_matches(content, {lit(T.HAS_TEXT_PATTERN)})"""


def grams(source: str, keys: str, text: str) -> str:
    letters = f"' ' || trim(regexp_replace(lower({text}), '[^\\p{{L}}]+', ' ', 'g')) || ' '"
    return f"""select {keys}, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i+1] || c[i+2])) gram
      from (select {keys}, string_split({letters}, '') c from {source})"""


def scores(source: str, keys: str, text: str) -> str:
    return f"""select {keys}, p.lang, cast(sum(p.weight) as bigint) s
      from ({grams(source, keys, text)}) g join x_profile p using (gram) group by {keys}, p.lang"""


def probabilities(source: str, keys: str) -> str:
    """Rows (keys, lang, prob, rank) from rows (keys, lang, s)."""
    return f"""select *, cast(row_number() over (partition by {keys} order by prob desc, lang) - 1 as integer) rank
      from (select {keys}, lang, round(e / sum(e) over (partition by {keys}), 4) prob
            from (select {keys}, lang, exp((s - max(s) over (partition by {keys})) / 1000000.0::double) e
                  from {source})) where prob >= {L.MIN_PROBABILITY}"""


def top(source: str, keys: str) -> str:
    return f"""select {keys}, lang from {source}
      qualify row_number() over (partition by {keys} order by s desc, lang desc) = 1"""


def lang_text(source: str, keys: str) -> str:
    return f"""select {keys}, count(*) n, '[' || string_agg(lang || ':' || cast(prob as varchar), ', ' order by rank) || ']' langs
      from {source} group by {keys}"""


def matches(value: str, patterns) -> str:
    return "(" + " or ".join(f"regexp_matches({value}, {lit(p)})" for p in patterns) + ")"


def csv_field(column: str) -> str:
    c = f"coalesce(cast({column} as varchar), '')"
    return (
        f"case when regexp_matches({c}, '[;\"\\n\\r]') then '\"' || replace({c}, '\"', '\"\"') || '\"' "
        f"else {c} end"
    )


CSV_LINE = " || ';' || ".join(csv_field(c) for c in CSV_COLUMNS)
SCHEME_OK = "split_part(url, '://', 1) in ('http', 'https', 'file', 'ftp')"
DENIED = f"{extension('url')} in ({', '.join(lit('.' + e) for e in K.DENIED_EXTENSIONS)})"


def messages(source: str, limit: int, seeds: str | None = None) -> str:
    """Paragraph messages of rows (spec, spider, page_id, xp_idx, pos, CSV columns), the chunks beyond the last
    row and, of ``seeds`` (spec, spider), those without rows with the header alone."""
    head = f"{lit(CSV_HEADER)} || chr(10)"
    cut = chunked(source, limit, "spec, spider")
    rest = f"""
      union all select spec, false, spider, spider || '_part' || (c + 1) || '_' || chunks, {head} from (
        select spec, spider, chunks, unnest(range(n, chunks)) c from (select distinct spec, spider, chunks, n from ({cut})))"""
    if seeds:
        rest += f"""
      union all select spec, false, spider, spider, {head} from {seeds} where spec not in (select spec from {source})"""
    return f"""select spec crawl, false raw, spider url,
        case when chunks = 1 then spider else spider || '_part' || (chunk + 1) || '_' || chunks end filename,
        {head} || string_agg(line, chr(10) order by rn) || chr(10) as data
      from ({cut}) group by spec, spider, chunk, chunks{rest}"""


def chunked(source: str, limit: int, keys: str) -> str:
    return f"""select *, case when r < m * (q + 1) then r // (q + 1)
          else m + (r - m * (q + 1)) // greatest(q, 1) end as chunk
        from (select *, rn - 1 r, n // chunks q, n % chunks m from (
          select *, row_number() over (partition by {keys} order by page_id, xp_idx, pos) rn,
            count(*) over (partition by {keys}) n,
            cast(ceil((sum(strlen(line) + 1) over (partition by {keys}) + {len(CSV_HEADER) + 1}) / {limit}) as bigint) chunks
          from (select {keys}, page_id, xp_idx, pos, {CSV_LINE} line from {source})))"""


FORMS = f"""[url, 'http://user:pw@' || h || ':8080/a;b?x=1#f',
  {part('url', 1)} || '://' || h || '/file-' || page_id || '.tar.GZ', 'mailto:me@' || h,
  'javascript:void(0)', 'https://' || upper(h), 'http://sub.' || h || '/a b|c/?z=2&a=1&b&a-b=3&z=1#top',
  'ftp://' || h || '/dir/.bashrc']"""
LONG_URL = f"'http://' || {netloc('url')} || '/{'section/' * 8}' || (page_id % 3) || '/{'item-' * 12}page.html'"
COLLIDING_URL = f"'http://' || {netloc('url')} || '/doc' || (page_id % 3) || '?v=' || page_id"
RAW_OK = "(contains(lower(content_type), 'text/html') or contains(lower(content_type), 'application/pdf'))"
SHORT = "substr(f, 1, 47) || '(...)' || right(f, 48)"
STEM = r"(?s)^(.*)\.([^.]*)$"

CTES = {
    "x_resp": """select page_id, url, case page_id % 10 when 0 then 'application/pdf'
        when 1 then 'Text/HTML; charset=utf-8' when 2 then 'image/png' else 'text/html' end content_type,
      html body, cast(page_id % 7 as integer) depth,
      case when page_id % 17 = 5 then 'TimeoutError' end failure from pages""",
    "x_seeds": f"""select 'crawl-' || page_id spec, url, domain, {filename('url')} spider from (
      select page_id, url, {netloc('url')} as domain, count(*) over (partition by {netloc('url')}) n,
        row_number() over (partition by {netloc('url')} order by page_id) k from pages) where n <> 2 and k = 1""",
    "x_edges": """select s.url src_url, t.url url from (
      select url, unnest([(page_id * 7 + 3) % n, (page_id * 11 + 5) % n]) dst
      from pages, (select count(*) n from pages)) s join pages t on t.page_id = s.dst""",
    "x_cseeds": f"""select domain as spider, domain, arg_min(url, page_id) url from (
      select page_id, url, regexp_extract({netloc('url')}, '[^.]+[.][^.]+$') as domain from pages) group by domain""",
    "x_forms": f"""select page_id, unnest(f) url, cast(generate_subscripts(f, 1) - 1 as integer) form from (
      select page_id, {FORMS} f from (select page_id, url, {netloc('url')} h from pages))""",
    "x_vis": f"select page_id, url, regexp_replace(html, {lit(H.HIDDEN_PATTERN)}, '', 'g') v from pages",
    "x_td": f"""select page_id, url, cast(page_id % 7 as integer) depth, regexp_replace(
        case when page_id % 5 = 0 then replace(replace(html, '<p>', '<td>'), '</p>', '</td>') else html end,
        {lit(H.HIDDEN_PATTERN)}, '', 'g') v from pages""",
    "x_par": elements("x_td", "//p", 0, "page_id, url, depth")
    + " union all "
    + elements("x_td", "//td", 1, "page_id, url, depth"),
    "x_every_link": f"""select page_id, src_url, pos, {part('src_url', 1)} || '://' || {netloc('src_url')} || href as url, text from (
      select page_id, url src_url, pos, {entities('raw')} href, {entities('inner_text')} as text from (
        select page_id, url, cast(pos as integer) pos,
          regexp_extract(b, {lit(H.HREF_PATTERN)}, 1) || regexp_extract(b, {lit(H.HREF_PATTERN)}, 2)
            || regexp_extract(b, {lit(H.HREF_PATTERN)}, 3) raw,
          {without_tags(r"regexp_replace(regexp_replace(b, '(?s)^[^>]*(?:>|\z)', ''), '(?is)</a(?:[\s>].*|\z)', '')")} inner_text
        from (select page_id, url, unnest(l) b, generate_subscripts(l, 1) - 1 pos from (
          select page_id, url, string_split_regex(v, {lit(H.LINK_OPEN_PATTERN)})[2:] l from x_vis))
        where regexp_matches(b, {lit(H.HREF_PATTERN)})))""",
    "x_links": """select * from x_every_link
      qualify row_number() over (partition by page_id, url order by pos) = 1""",
    "x_cand": """select page_id, url, text from x_links
      union all select page_id, url, 'form ' || form from x_forms""",
    "x_audit": f"""select *, case when not {SCHEME_OK} then 'scheme'
        when not {matches('url', C.ALLOW)} then 'whitelist' when {matches('url', C.DENY)} then 'blacklist'
        when {' or '.join(under(f"lower({netloc('url')})", lit(d)) for d in C.DENY_DOMAINS)} then 'deny_domain'
        when {DENIED} then 'extension' when not regexp_matches(text, '[a-z]') then 'text' end reason
      from x_cand""",
    "x_counts": f"""select lang, gram, count(*) cnt from ({grams('documents', 'lang', 'text')}) group by lang, gram""",
    "x_top": f"""select lang, gram, cnt from x_counts
      qualify row_number() over (partition by lang order by cnt desc, gram) <= {L.TOP_GRAMS}""",
    "x_kept": "select distinct gram from x_counts",
    "x_profile": f"""select t.lang, k.gram, cast(round({L.WEIGHT_SCALE} *
        ln((coalesce(c.cnt, 0) + 1) / cast(t.n + v.v as double))) as bigint) weight
      from x_kept k cross join (select lang, sum(cnt) n from x_counts group by lang) t
      cross join (select count(*) v from x_kept) v
      left join x_counts c on c.lang = t.lang and c.gram = k.gram""",
    "x_parscore": scores("x_par", "page_id, xp_idx, pos", "content"),
    "x_partop": top("x_parscore", "page_id, xp_idx, pos"),
    "x_text": "select page_id, string_agg(content, ' ' order by xp_idx, pos) page_text from x_par group by page_id",
    "x_pagescore": scores("x_text", "page_id", "page_text"),
    "x_pageprob": probabilities("x_pagescore", "page_id"),
    "x_pagelangs": lang_text("x_pageprob", "page_id"),
    "x_partagged": f"""select p.*, coalesce(t.lang, {lit(L.NO_FEATURES)}) par_language
      from x_par p left join x_partop t using (page_id, xp_idx, pos)""",
    "x_rows": """select p.*, a.lang page_language from x_partagged p
      left join (select page_id, lang from x_pageprob where prob > 0.5 and lang in ('de', 'en')) a using (page_id)
      where a.lang is not null or p.page_id not in (select page_id from x_pageprob)""",
    "x_crawl": f"""select r.*, s.spec, s.spider from x_rows r join x_seeds s on s.domain = {netloc('r.url')}""",
    "x_rawresp": f"""select page_id, case page_id % 3 when 0 then {LONG_URL} when 1 then {COLLIDING_URL} else url end url,
        body from x_resp where {RAW_OK}""",
    "x_rawnamed": f"""select r.page_id, r.url, r.body, s.spec, s.spider, {raw_name('r.url')} f
      from x_rawresp r join x_seeds s on s.domain = {netloc('r.url')}""",
    "x_files": f"""select spec, spider, case when k = 1 then a else regexp_extract(a, {lit(STEM)}, 1)
          || ' (' || (k - 1) || ').' || regexp_extract(a, {lit(STEM)}, 2) end filename, url, body as content
        from (select *, {SHORT} a, row_number() over (partition by spec, spider, {SHORT} order by page_id) k
              from x_rawnamed where length(f) > 100)
      union all select spec, spider, f, url, body from x_rawnamed where length(f) <= 100
        qualify row_number() over (partition by spec, spider, f order by page_id desc) = 1""",
    "x_turnscore": scores("conversations", "conv_id, turn", "text"),
    "x_specs": """select page_id, page_id % 4 k, 'crawl-' || page_id as name, 'out/' || page_id as output,
        'logs/' || page_id as logs, url || ' ' || regexp_extract(url, '^[^#]*') || ' ' || url as urls,
        case page_id % 4 when 0 then 'utm_source= /de/[0-9]' when 2 then '[?]page=' else '' end blacklist,
        case page_id % 4 when 0 then '//blog[.] /en/[0-9]*5 example[.]com' else '' end whitelist,
        case page_id % 4 when 1 then 'parsers.RawParser' else 'parsers.ParagraphParser' end parser,
        case page_id % 4 when 2 then 'de en' when 3 then 'disabled' else 'any' end allowed_languages,
        page_id % 4 = 3 keep_langdetect_errors, '//p //td' xpaths,
        'text/html application/pdf' allowed_content_type,
        case page_id % 4 when 1 then 'pipelines.Raw2FilePipeline=300' when 3 then ''
          else 'pipelines.Paragraph2CsvPipeline=300' end pipelines,
        case page_id % 4 when 2 then 'pipelines.RemoteCrawlFinalizer' else '' end finalizers
      from pages""",
    "x_keyed": f"""select distinct {canonical('src_url')} src, {canonical('url')} as key from x_edges""",
    "x_fr": f"""select spider, domain, {canonical('url')} as key, 0 depth from x_cseeds
      union select f.spider, f.domain, e.key, f.depth + 1 from x_fr f join x_keyed e on e.src = f.key
      where f.depth < 5 and {under(f"lower({netloc('e.key')})", 'f.domain')}""",
}


def with_ctes(body: str) -> str:
    """Prefix ``body`` with the CTEs it needs, in the order of their definition."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        for name in re.findall(r"\bx_\w+", todo.pop()):
            if name in CTES and name not in needed:
                needed.add(name)
                todo.append(CTES[name])
    parts = [f"{name} as ({sql})" for name, sql in CTES.items() if name in needed]
    return f"with recursive {', '.join(parts)} {body}" if parts else body


SPEC_COLUMNS = (
    "name, output, logs, urls, blacklist, whitelist, parser, allowed_languages, "
    "keep_langdetect_errors, xpaths, allowed_content_type, pipelines, finalizers"
)
ROW_COLUMNS = ", ".join(C.ROW_COLUMNS)
RAW_MESSAGES = """select spec crawl, true raw, spider url, filename, content as data from x_files
  where ends_with(filename, '.html')"""
FORM_ID = "page_id, form"


def _resolve() -> str:
    refs = "[" + ", ".join(lit(r) for r in fx.REFERENCES) + "]"
    head = "(?s)^[^?#]*"
    folder = f"regexp_extract({path('url')}, '(?s)^(.*/)?[^/]*$', 1)"
    return f"""select page_id, ref, case when ref = '' then url
        when regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') then ref
        when starts_with(ref, '//') then scheme || ':' || ref
        when starts_with(ref, '#') then regexp_extract(url, '(?s)^[^#]*') || ref
        when starts_with(ref, '?') then regexp_extract(url, '(?s)^[^?#]*') || ref
        else scheme || '://' || host || '/' || array_to_string(kept, '/')
          || case when len(kept) > 0 and segs[-1] in ('.', '..') then '/' else '' end
          || regexp_extract(ref, '(?s)^[^?#]*(.*)$', 1) end absolute
      from (select *, list_reduce(segs, lambda acc, s: case when s = '.' then acc
              when s = '..' then acc[:greatest(len(acc) - 1, 0)] else list_append(acc, s) end, []::varchar[]) kept
        from (select *, string_split(regexp_replace(target, '/+', '/', 'g'), '/')[2:] segs
          from (select page_id, url, ref, {part('url', 1)} scheme, {netloc('url')} host,
              case when starts_with(ref, '/') then regexp_extract(ref, {lit(head)})
                else case when {folder} = '' then '/' else {folder} end || regexp_extract(ref, {lit(head)}) end target
            from (select page_id, url, unnest({refs}) ref from pages))))"""


def _normalized() -> str:
    exts = "[" + ", ".join(lit(e) for e in fx.EXTENSIONS) + f", {extension('url')}]"
    cases = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in U.EXTENSION_SYNONYMS.items())
    return f"""select page_id, form, case e {cases} else e end ext from (
      select page_id, cast(generate_subscripts(x, 1) - 1 as integer) form,
        case when unnest(x) = '' or starts_with(unnest(x), '.') then lower(unnest(x)) else '.' || lower(unnest(x)) end e
      from (select page_id, {exts} x from pages))"""


def _accepted(languages: str) -> str:
    return f"select page_id, lang from x_pprob where prob > 0.5 and lang in ({languages})"


def _page_filter() -> str:
    """Own CTEs: pages without rewritten cells, paragraphs only."""
    par = elements("x_vis", "//p", 0, "page_id, url")
    text = f"select page_id, string_agg(content, ' ' order by pos) t from ({par}) group by page_id"
    scored = scores(f"({text})", "page_id", "t")
    return f"""select p.page_id, p.url, a.lang page_language from pages p join (
      {probabilities(f'({scored})', 'page_id')}) a on a.page_id = p.page_id
      where a.prob > 0.5 and a.lang in ('fr', 'es')"""


def _stream_messages() -> str:
    cells = " union all ".join(elements("x_vis", x, i, "page_id, url") for i, x in enumerate(("//p", "//td")))
    owned = f"""(select p.*, s.spec, s.spider, null par_language, null page_language, 0 depth
      from ({cells}) p join x_seeds s on s.domain = {netloc('p.url')} where p.page_id % 10 not in (0, 2))"""
    return messages(owned, MESSAGE_LIMIT)


def _stream_rows() -> str:
    return " union all ".join(
        f"select page_id, url, xp_idx, pos, origin, content from ({elements('x_vis', x, i, 'page_id, url')}) "
        "where page_id % 10 not in (0, 2)"
        for i, x in enumerate(("//p", "//td"))
    )


def _rule_join() -> str:
    """Rules of the four kinds of specification, by page."""
    kind = "page_id % 4"
    allow = matches("url", ["//blog[.]", "/en/[0-9]*5", "example[.]com"])
    return f"""select 'crawl-' || page_id spec, page_id, url, text, case when not {SCHEME_OK} then 'scheme'
      when {kind} = 0 and not {allow} then 'whitelist'
      when {kind} = 0 and {matches('url', ['utm_source=', '/de/[0-9]'])} then 'blacklist'
      when {kind} = 2 and regexp_matches(url, '[?]page=') then 'blacklist'
      when {DENIED} then 'extension' end reason from x_cand"""


def _robots() -> str:
    place = f"({part('url', 3)} || case when {part('url', 4)} <> '' then '?' || {part('url', 4)} else '' end)"
    rules = [(False, "/de/", "^/de/"), (True, "/de/1", "^/de/1"), (False, "/*page=", "^/.*page=")]
    rules += [(True, "/en/1*?page=", "^/en/1.*[?]page="), (False, "/*7$", "^/.*7$")]
    table = ", ".join(f"({str(a).lower()}, {len(rule)}, {lit(p)})" for a, rule, p in rules)
    return f"""select page_id, url from (select *, {place} as place, {netloc('url')} as host from pages) p
      where not coalesce(host in (select domain from x_seeds) and not (
        select max({{'n': n, 'a': a}}).a from (values {table}) r(a, n, x) where regexp_matches(p.place, r.x)), false)"""


def _registered() -> str:
    html = " union all ".join(
        f"select page_id, xp_idx, pos, origin, content from ({elements('x_vis', x, i, 'page_id')}) "
        "where page_id % 10 not in (0, 2)"
        for i, x in enumerate(("//h1", "//p"))
    )
    lines = f"string_split_regex({entities(without_tags('html'))}, {lit(T.LINE_BREAK_PATTERN)})"
    return f"""{html} union all select page_id, null, pos, 'pdf', content from (
      select page_id, cast(generate_subscripts(l, 1) - 1 as integer) pos, unnest(l) content
      from (select page_id, {lines} l from pages where page_id % 10 = 0))
      where regexp_matches(content, {lit(T.HAS_TEXT_PATTERN)})"""


def _elements() -> str:
    ad = "(?is)<div class=\"ad\">(.*?)</div>"
    return f"""{elements('x_vis', '//h1', 0, 'page_id')}
      union all select page_id, 1, pos, '//nav//a', text from x_every_link
      union all select page_id, 2, 0, '//div[@class=''ad'']', {entities('t')} from (
        select page_id, {without_tags(f"regexp_extract(v, {lit(ad)}, 1)")} t from x_vis) where t <> ''"""


def _task_crawl() -> str:
    """Paragraphs of the start pages of the undamaged specifications, languages as each kind asks for them."""
    head = f"select 'crawl-' || p.page_id spec, {filename('p.url')} spider, p.page_id, p.xp_idx, p.pos, p.content"
    mine = "p.page_id % 7 in (0, 6) and p.page_id % 4 ="
    return f"""select *, cast(0 as integer) as depth from (
      {head}, p.par_language, l.langs page_language from x_partagged p join x_pagelangs l using (page_id) where {mine} 0
      union all {head}, p.par_language, a.lang from x_partagged p join x_pageprob a using (page_id)
        where {mine} 2 and a.prob > 0.5 and a.lang in ('de', 'en')
      union all {head}, null, null from x_par p where {mine} 3)"""


def _tasks(where: str) -> str:
    return f"""select event_id msg_id, event_id % 13 = 0 redelivered,
      '{{"name":"task-' || event_id || '","urls":["http://example.com/' || user_id || '"]}}' body from events {where}"""


def _blank_test() -> str:
    blanks = "['', ' ' || chr(9), chr(160), chr(28), chr(133) || chr(12288), 'x' || chr(160)]"
    return f"""select * from (select conv_id, turn, case when conv_id % 2 = 0 then {blanks}[turn % 6 + 1]
      else text end content from conversations) where regexp_matches(content, {lit(T.HAS_TEXT_PATTERN)})"""


def _csv_rows(columns: str) -> str:
    empty = ", ".join(f"nullif({c}, '') {c}" for c in CSV_COLUMNS if c != "depth")
    return f"select {columns} from (select spider, {empty}, depth from x_crawl)"


def _overlaid() -> str:
    three, six = "page_id % 3 = 0", "page_id % 6 = 0"
    return f"""select name, case when {six} then 'new/' || page_id else output end output, logs,
      case when {three} then split_part(urls, ' ', 1) else urls end urls, blacklist,
      case when {six} then 'patched' else whitelist end whitelist, parser, allowed_languages,
      keep_langdetect_errors, xpaths, allowed_content_type,
      case when {three} then 'pipelines.Patched=1' else pipelines end pipelines, finalizers from x_specs"""


def _bodies() -> dict[str, str]:
    seeded = "select domain from x_seeds"
    host = f"lower({netloc('url')})"
    pivot = ", ".join(f"count(*) filter (where par_language = {lit(x)}) {x}" for x in ("de", "en"))
    wide = ", ".join(f"cast(sum(s) filter (where lang = {lit(x)}) as bigint) s_{x}" for x in fx.MODEL_LANGUAGES)
    dispatched = messages(
        "(select c.* from x_crawl c join x_specs p on p.name = c.spec where p.k <> 1)",
        C.CHUNK_LIMIT,
        "(select s.* from x_seeds s join x_specs p on p.name = s.spec where p.k <> 1)",
    )
    return {
        "scan_specs": f"select {SPEC_COLUMNS} from x_specs",
        "overlay_specs": _overlaid(),
        "seed_urls": f"""select distinct name spec, u url, {netloc('u')} as domain, {filename('u')} spider
          from (select name, unnest(string_split(urls, ' ')) u from x_specs)""",
        "scan_pages": "select page_id, url, content_type, body, depth from x_resp",
        "scan_paragraph_csv": _csv_rows("spider, " + ", ".join(CSV_COLUMNS)),
        "scan_raw_files": """select spider, filename, url, content from x_files
          where ends_with(filename, '.html')""",
        "write_paragraph_csv": "select s.spider, count(c.page_id) n_rows from x_seeds s left join x_crawl c on c.spec = s.spec group by s.spider",
        "raw_file_table": "select spider, filename, url, content from x_files",
        "paragraph_messages": messages("x_crawl", MESSAGE_LIMIT, "x_seeds"),
        "paragraph_messages_chunked": messages("x_crawl", C.CHUNK_LIMIT, "x_seeds"),
        "raw_messages": RAW_MESSAGES,
        "send_result": RAW_MESSAGES,
        "dispatch_finalizer": f"""{dispatched} union all {RAW_MESSAGES}
          and spec in (select name from x_specs where k = 1)""",
        "url_netloc": f"select {FORM_ID}, {netloc('url')} url_netloc from x_forms",
        "url2filename": f"select {FORM_ID}, {filename('url')} url2filename from x_forms",
        "raw_filename": f"select {FORM_ID}, {raw_name('url')} raw_filename from x_forms",
        "url_scheme_ok": f"select {FORM_ID}, {SCHEME_OK} url_scheme_ok from x_forms",
        "url_extension": f"select {FORM_ID}, {extension('url')} url_extension from x_forms",
        "canonical_url": f"select {FORM_ID}, {canonical('url')} canonical_url from x_forms",
        "abbreviate_filename": f"""select page_id, case when length(f) > 100 then {SHORT} else f end filename
          from (select page_id, {raw_name(LONG_URL)} f from pages
                union all select page_id, {raw_name(COLLIDING_URL)} from pages)""",
        "host_in_domains": f"""select {FORM_ID}, {under(host, "'example.com'")}
          or {under(host, "'spam-farm.example.org'")} inside from x_forms""",
        "resolve_url": _resolve(),
        "normalize_extension": _normalized(),
        "route_content_type": """select page_id, content_type,
          case when contains(lower(content_type), 'text/html') then 'text/html'
            when contains(lower(content_type), 'application/pdf') then 'application/pdf' end handler from x_resp""",
        "extract_paragraphs": f"""select page_id, url, pos, origin, content
          from ({elements('x_vis', '//p', 0, 'page_id, url')})""",
        "element_text": f"""select page_id, {entities('t')} content from (
          select page_id, {without_tags('v')} t from x_vis)""",
        "split_lines": f"""select doc_id, pos, content, 'pdf' origin from (
          select doc_id, cast(generate_subscripts(l, 1) - 1 as integer) pos, unnest(l) content
          from (select doc_id, string_split_regex(text, {lit(T.LINE_BREAK_PATTERN)}) l from documents))
          where regexp_matches(content, {lit(T.HAS_TEXT_PATTERN)})""",
        "extract_links": "select page_id, src_url, pos, url, text from x_links",
        "decode_body": r"""select page_id, case when page_id % 2 = 0 then html
          else regexp_replace(html, '[^\x00-\x{ff}]', '', 'g') end body from pages""",
        "raw_items": f"select page_id, url, body as content, depth from x_resp where {RAW_OK}",
        "paragraph_rows": f"select {ROW_COLUMNS} from x_rows",
        "paragraph_rows_any": f"""select {ROW_COLUMNS} from (select p.*, l.langs page_language
          from x_partagged p join x_pagelangs l using (page_id))""",
        "paragraph_rows_disabled": f"""select {ROW_COLUMNS} from (select *, cast(null as varchar) par_language,
          cast(null as varchar) page_language from x_par)""",
        "drop_blank": _blank_test(),
        "whitelist": f"select * from x_cand where {matches('url', C.ALLOW)}",
        "blacklist": f"select * from x_cand where not {matches('url', C.DENY)}",
        "valid_scheme": f"select * from x_cand where {SCHEME_OK}",
        "allow_deny_domains": f"""select * from x_cand c where exists (select 1 from x_seeds s
            where {under(f"lower({netloc('c.url')})", 's.domain')})
          and not exists (select 1 from (select distinct {netloc('url')} d from pages) b
            where regexp_matches(d, 'spam-farm|cheap-pills') and {under(f"lower({netloc('c.url')})", 'b.d')})""",
        "deny_extensions": f"select * from x_cand where not {DENIED}",
        "restrict_text": f"select * from x_cand where {matches('text', ['^[Tt]h', 'form [0-3]'])}",
        "page_language_filter": _page_filter(),
        "in_domain": f"""select f.page_id, f.form, f.url, s.spider from x_forms f
          join x_seeds s on s.domain = {netloc('f.url')}""",
        "depth_limit": "select page_id, url, depth from x_resp where depth <= 5",
        "robots_filter": _robots(),
        "content_type_allow": f"select page_id, url, content_type from x_resp where {RAW_OK}",
        "html_only": f"""select {FORM_ID}, {raw_name('url')} filename from x_forms
          where ends_with({raw_name('url')}, '.html')""",
        "link_audit": "select * from x_audit",
        "pages_to_spiders": f"""select s.domain, p.page_id, p.url, s.spider, s.spec from pages p
          join x_seeds s on s.domain = {netloc('p.url')}""",
        "semi_in_domain": f"select page_id, url from pages where {netloc('url')} in ({seeded})",
        "anti_visited": f"""select {canonical('url')} as key, src_url, url from x_edges
          where {canonical('url')} not in (select {canonical('url')} from pages where page_id % 2 = 0)""",
        "regex_rule_join": _rule_join(),
        "page_score_join": """select p.page_id, p.xp_idx, p.pos, l.lang page_top from x_par p
          join x_pageprob l on l.page_id = p.page_id and l.rank = 0""",
        "ngram_profile_join": f"select conv_id, turn, {wide} from x_turnscore group by conv_id, turn",
        "paragraphs_per_page": """select t.page_id, t.url, count(p.pos) n_paragraphs from x_td t
          left join x_par p using (page_id) group by t.page_id, t.url""",
        "language_histogram": "select par_language, count(*) n from x_crawl group by par_language",
        "page_text": """select t.page_id, coalesce(x.page_text, '') page_text from x_td t
          left join x_text x using (page_id)""",
        "page_language_distribution": "select page_id, cast(n as integer) n_langs, langs from x_pagelangs",
        "language_stats_pivot": f"select page_id, url, {pivot} from x_crawl group by page_id, url",
        "result_size": f"""select spider, count(*) n_rows, cast(sum(strlen({CSV_LINE}) + 1) + {len(CSV_HEADER) + 1} as bigint) n_bytes
          from x_crawl group by spider""",
        "drop_report": """select stage, reason, count(*) n from (
            select 'request' stage, failure reason from x_resp where failure is not null
            union all select 'route', lower(content_type) from x_resp
              where failure is null and not contains(lower(content_type), 'text/html')
            union all select 'link', reason from x_audit where reason is not null)
          group by grouping sets ((stage, reason), (stage))""",
        "unique_long_names": f"""select spider, case when k = 1 then a else regexp_extract(a, {lit(STEM)}, 1)
            || ' (' || (k - 1) || ').' || regexp_extract(a, {lit(STEM)}, 2) end filename, page_id
          from (select *, row_number() over (partition by spider, a order by page_id) k
            from (select spider, page_id, {SHORT} a from (
              select {netloc('url')} spider, page_id, {raw_name(LONG_URL)} f from pages) where length(f) > 100))""",
        "last_writer_wins": f"""select {netloc('url')} spider, {raw_name(COLLIDING_URL)} filename, max(page_id) page_id
          from pages group by 1, 2""",
        "chunk_rows": f"""select spider, page_id, xp_idx, pos, line, rn, chunks, chunk
          from ({chunked('x_crawl', C.CHUNK_LIMIT, 'spider')})""",
        "first_link_per_page": "select page_id, src_url, pos, url, text from x_links",
        "top_language": top("x_turnscore", "conv_id, turn"),
        "paragraph_order": "select page_id, xp_idx, pos, content from x_par order by page_id, xp_idx, pos",
        "langs_by_prob": "select page_id, rank, lang, prob from x_pageprob",
        "top_ngrams": "select lang, gram, cnt from x_top",
        "union_xpaths": " union all ".join(
            f"select page_id, xp_idx, pos, origin, content from ({elements('x_td', x, i, 'page_id')})"
            for i, x in enumerate(("//td", "//p", "//td", "//h1"))
        ),
        "distinct_urls": "select distinct unnest(string_split(urls, ' ')) url from x_specs",
        "new_minus_seen": f"""select {canonical('url')} as key from x_edges except
          select {canonical('url')} from pages where page_id % 2 = 0""",
        "crawl_frontier": "select spider, key, min(depth) depth from x_fr group by spider, key",
        "ngram_profiles": "select lang, gram, weight from x_profile",
        "detect_paragraph_lang": f"""select c.conv_id, c.turn, case when c.turn % 9 = 8 then {lit(L.NO_FEATURES)}
            else coalesce(t.lang, {lit(L.NO_FEATURES)}) end par_language
          from conversations c left join ({top('x_turnscore', 'conv_id, turn')}) t using (conv_id, turn)""",
        "detect_page_langs": f"""select doc_id, lang, prob from (
          {probabilities('(' + scores('documents', 'doc_id', 'text') + ')', 'doc_id')})""",
        "format_lang_list": f"""select conv_id, turn, langs from ({lang_text(
            '(' + probabilities('x_turnscore', 'conv_id, turn') + ')', 'conv_id, turn')})""",
        "stream_tasks": _tasks("") + " union all " + _tasks("where event_id % 20 = 0"),
        "drop_redelivered": f"select msg_id, body from ({_tasks('')}) where not redelivered",
        "stream_parse": _stream_rows(),
        "task_crawl": _task_crawl(),
        "reject_specs": """select page_id, case page_id % 7 when 1 then 'not JSON' when 2 then 'not an object'
            when 3 then 'field of another type' when 4 then 'no name' else 'empty' end reason
          from pages where page_id % 4 <> 1 and page_id % 7 between 1 and 5""",
        "stream_results": _stream_messages(),
        "send_tasks": f"select {SPEC_COLUMNS} from x_specs",
        "register_parser": _registered(),
        "run_pipelines": f"""select page_id, url, 'abc' as trace from pages
          where ends_with({netloc('url')}, '.example.com')""",
        "run_finalizers": """select spider, 'rows' finalizer, count(*) as value from x_crawl group by spider
          union all select spider, 'pages', count(distinct page_id) from x_crawl group by spider""",
        "html_elements": _elements(),
    }


def oracle_sql() -> dict[str, str]:
    return {name: with_ctes(body) for name, body in _bodies().items()}
