"""DuckDB SQL that gives the expected result of each registered query on the same tables."""

from __future__ import annotations

from disclosure_spark.functions.text import ABBREVIATIONS
from disclosure_spark.functions.wordpiece import BASIC_TOKEN, CONTROL, SPECIAL
from disclosure_spark.operators.curves import NB_SIZES, SIZES

ORACLES: dict[str, str] = {}

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
WORD = r"[\p{L}\p{N}_]+"


def words(expr: str) -> str:
    return rf"len(regexp_extract_all({expr}, '{WORD}'))"


def single_line(expr: str) -> str:
    return f"regexp_replace({expr}, '{WS}', ' ', 'g')"


def unix(expr: str) -> str:
    return rf"regexp_replace({expr}, '\r\n?', chr(10), 'g')"


def lines(expr: str) -> str:
    return rf"case when {expr} = '' then [] else string_split(regexp_replace({unix(expr)}, '\n\z', ''), chr(10)) end"


def sentences(expr: str) -> str:
    names = "|".join(ABBREVIATIONS)
    held = rf"regexp_replace({expr}, '(^|[^\p{{L}}\p{{N}}_])({names})\.', '\1\2' || chr(1), 'g')"
    held = rf"regexp_replace({held}, '(^|[^\p{{L}}\p{{N}}_])((?:\p{{Lu}}\.)*\p{{Lu}})\.', '\1\2' || chr(1), 'g')"
    cut = rf"""regexp_replace({held}, '([.!?]+["'')\]”’]*) +', '\1' || chr(10), 'g')"""
    parts = f"string_split(replace({cut}, chr(1), '.'), chr(10))"
    return f"list_filter(list_transform({parts}, lambda s: trim(s)), lambda s: s != '')"


def meaningful(s: str) -> str:
    return rf"""({words(s)} between 8 and 95
      and not regexp_matches({s}, '[A-Z]+{WS}[A-Z]+')
      and not regexp_matches({s}, '(?i)table of contents')
      and len(list_filter(range(1, length({s}) - 1), lambda i: {s}[i] = {s}[i + 1] and {s}[i] = {s}[i + 2])) = 0)"""


REPORTS = """
reports as (
  select o_orderkey as report_id, o_custkey as cik, o_custkey % (select count(*) from supplier) as ticker,
         cast(o_orderdate as date) as filing_date, o_orderpriority as form_type
  from orders)"""
SPARSE_REPORTS = """
reports as (
  select o_orderkey as report_id, o_custkey as cik, o_custkey as ticker,
         cast(o_orderdate as date) as filing_date, o_orderpriority as form_type
  from orders)"""
TRADING_DAY = """
trading_day as (
  select l_suppkey as ticker, cast(l_shipdate as date) as date,
         min_by(l_extendedprice, (l_orderkey, l_linenumber, l_partkey)) as open,
         max_by(l_extendedprice, (l_orderkey, l_linenumber, l_partkey)) as close
  from lineitem group by 1, 2)"""
LABELLED = """
fwd as (
  select ticker, date, open, lead(close, 2) over (partition by ticker order by date) as close_after from trading_day),
labelled as (
  select r.*, (f.close_after - f.open) / f.open as change_ratio,
         case when (f.close_after - f.open) / f.open >= 0 then 'positive' else 'negative' end as change_nominal
  from reports r asof join fwd f on r.ticker = f.ticker and f.date >= r.filing_date
  where f.close_after is not null and f.open <> 0)"""
MEMBERSHIP = """
membership as (
  select distinct cast(date_trunc('quarter', o_orderdate) + interval 3 month as date) as snapshot_date, o_custkey as cik
  from orders)"""
CIK_MAP = """
cik_map as (
  select s_suppkey as ord, s_suppkey as cik, s_name as ticker, 'Company ' || s_suppkey as name from supplier
  union all
  select s_suppkey + 1000000000, s_suppkey + 1000000000, s_name, 'Company ' || s_suppkey || ' again'
  from supplier where s_suppkey % 10 = 0)"""
DOC_LINES = f"""
doc_lines as (
  select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as pos
  from (select doc_id, {lines('text')} as l from documents))"""

ORACLES["filing_filter"] = """
select o_orderkey as report_id, o_custkey as cik, strftime(o_orderdate, '%Y-%m-%d') as filing_date, o_orderpriority as form_type
from orders where year(o_orderdate) between 1996 and 1999 and o_orderpriority in ('1-URGENT', '2-HIGH')"""

ORACLES["unpivot_composition"] = f"""
with {MEMBERSHIP}, {CIK_MAP},
firsts as (select ticker, min_by(cik, ord) as cik from cik_map group by ticker),
hit as (
  select distinct m.snapshot_date, f.cik
  from membership m join firsts f on f.ticker = 'Supplier#' || lpad(cast(m.cik as varchar), 9, '0')
  where m.snapshot_date > date '1995-06-30')
select strftime(snapshot_date, '%Y-%m-%d') as snapshot_date, cik from hit"""

ORACLES["members_per_snapshot"] = f"""
with {MEMBERSHIP}
select strftime(snapshot_date, '%Y-%m-%d') as snapshot_date, count(*) as n_members from membership group by 1"""

ORACLES["ticker_first_match"] = f"""
with {CIK_MAP},
firsts as (select cik, min_by(ticker, ord) as ticker, min_by(name, ord) as company from cik_map group by cik)
select f.l_orderkey, f.cik, m.ticker, m.company
from (select distinct l_orderkey, l_suppkey as cik from lineitem) f left join firsts m using (cik)"""

ORACLES["unmatched_tickers"] = f"""
with {MEMBERSHIP}
select distinct 'Supplier#' || lpad(cast(cik as varchar), 9, '0') as ticker from membership
where 'Supplier#' || lpad(cast(cik as varchar), 9, '0') not in (select s_name from supplier)"""

ORACLES["membership_asof"] = f"""
with {SPARSE_REPORTS}, {MEMBERSHIP},
snaps as (select distinct snapshot_date from membership),
dated as (select r.*, s.snapshot_date from reports r asof join snaps s on s.snapshot_date <= r.filing_date)
select d.report_id, d.cik, strftime(d.filing_date, '%Y-%m-%d') as filing_date, strftime(d.snapshot_date, '%Y-%m-%d') as snapshot_date
from dated d semi join membership m on m.snapshot_date = d.snapshot_date and m.cik = d.cik"""

ORACLES["label_price_change"] = f"""
with {REPORTS}, {TRADING_DAY}, {LABELLED}
select report_id, ticker, strftime(filing_date, '%Y-%m-%d') as filing_date, form_type,
       round(change_ratio, 6) as change_ratio, change_nominal from labelled"""

ORACLES["label_price_change_sparse"] = f"""
with {SPARSE_REPORTS}, {TRADING_DAY}, {LABELLED}
select report_id, ticker, round(change_ratio, 6) as change_ratio, change_nominal from labelled"""

ORACLES["positive_share_by_form"] = f"""
with {REPORTS}, {TRADING_DAY}, {LABELLED}
select form_type, count(*) as n_filings, count(*) filter (change_nominal = 'positive') as n_positive,
       round(count(*) filter (change_nominal = 'positive') / count(*), 6) as positive_share
from labelled group by form_type"""

ORACLES["not_loaded_tickers"] = """
select distinct o_custkey as ticker from orders where o_custkey not in (select s_suppkey from supplier)"""

ORACLES["company_rows"] = f"""
with {REPORTS}
select ticker, cast(min_by(cik, report_id) as varchar) as cik, 'Customer ' || min_by(cik, report_id) as name
from reports group by ticker"""

ORACLES["json_series_parse"] = """
select strftime(ts, '%Y-%m-%d') as date, user_id as ticker,
       min_by(value, (ts, event_id)) as open, max_by(value, (ts, event_id)) as close
from events where user_id % 10 not in (0, 1, 2) group by 1, 2"""

ORACLES["load_errors"] = """
select distinct user_id as ticker, case when user_id % 10 = 2 then 503 else 200 end as error_code,
       case when user_id % 10 = 0 then 'Invalid call for ' || user_id else '' end as error_message,
       case user_id % 10 when 0 then 'error' when 1 then 'note' else 'status' end as reason
from events where user_id % 10 in (0, 1, 2)"""

HEADER = "case when instr({0}, '</head>') > 0 then substr({0}, instr({0}, '</head>') + 7) else {0} end"
EXHIBIT = r"regexp_replace({0}, '(?s)<footer[^\n]*>.*\z', '')"

ORACLES["strip_header"] = f"select page_id, {HEADER.format('html')} as text from pages"
ORACLES["strip_exhibits"] = f"select page_id, {EXHIBIT.format('html')} as text from pages"

ORACLES["clean_filing"] = f"""
with raw as (
  select page_id as report_id, {unix('html')} as t from pages
  union all select -doc_id - 1, {unix('text')} from documents),
body as (select report_id, {HEADER.format('t')} as t from raw),
flat as (select report_id, {single_line(EXHIBIT.format('t'))} as t from body),
cut as (select report_id, list_filter({sentences('t')}, lambda s: {meaningful('s')}) as s from flat)
select report_id, cast(generate_subscripts(s, 1) - 1 as integer) as pos, unnest(s) as sentence from cut"""

ORACLES["split_sentences"] = f"""
with flat as (select doc_id as report_id, {single_line('text')} as t from documents),
cut as (select report_id, {sentences('t')} as s from flat)
select report_id, cast(generate_subscripts(s, 1) - 1 as integer) as pos, unnest(s) as sentence from cut"""

ORACLES["meaningful_sentences"] = f"""
with {DOC_LINES}
select doc_id as report_id, cast(pos as integer) as pos, line from doc_lines where {meaningful('line')}"""

ORACLES["word_count"] = f"""
select doc_id as report_id, cast(sum({words('text')}) as bigint) as n_words from documents group by rollup (doc_id)"""

ORACLES["words_per_line_hist"] = f"""
with {DOC_LINES}
select {words('line')} as words_in_sequence, count(*) as appearances from doc_lines group by 1"""


def packed(budget: int, lossless: bool, source: str = "doc_lines") -> str:
    """CTEs that fold the counted lines of each document into chunks ``packed(doc_id, chunk, text)``."""
    visible = "true" if lossless else "c.pos < m.last"
    at_overflow = "'start'" if lossless else "'drop'"
    fits = f"f.words is not null and f.words + c.n < {budget}"
    return f"""
counted as (select doc_id, pos, {words('line')} as n, line from {source}),
ends as (select doc_id, max(pos) as last from counted group by doc_id),
visible as (select c.doc_id, c.pos, c.n from counted c join ends m using (doc_id) where {visible}),
fold(doc_id, pos, act, words, chunk) as (
  select doc_id, pos, 'start', n, 0 from visible where pos = 0
  union all
  select c.doc_id, c.pos,
    case when {fits} then 'add' when f.words is null then 'start' else {at_overflow} end,
    case when {fits} then f.words + c.n when f.words is null or {'true' if lossless else 'false'} then c.n end,
    f.chunk + case when {fits} then 0 when f.words is null or {'true' if lossless else 'false'} then 1 else 0 end
  from fold f join visible c on c.doc_id = f.doc_id and c.pos = f.pos + 1),
packed as (
  select f.doc_id, f.chunk, string_agg(c.line, ' ' order by c.pos) as text
  from fold f join counted c using (doc_id, pos) where f.act <> 'drop' group by 1, 2)"""


for _mode in ("compat", "lossless"):
    ORACLES[f"pack_{_mode}"] = f"""
with recursive {DOC_LINES}, {packed(115, _mode == 'lossless')}
select doc_id as report_id, cast(chunk as integer) as chunk, text from packed"""


def split(source: str, key: str, first: float, second: float | None, names: tuple[str, ...]) -> str:
    """``source`` with an exact-size split column in hash order."""
    a = f"cast(floor(t.n * {first}) as bigint)"
    b = a if second is None else f"{a} + cast(floor(t.n * {second}) as bigint)"
    middle = "" if second is None else f"when r <= {b} then '{names[1]}'"
    return f"""(select s.* exclude (r), case when r <= {a} then '{names[0]}' {middle} else '{names[-1]}' end as split
  from (select *, row_number() over (order by md5({key} || ':42'), {key}) as r from {source}) s,
       (select count(*) as n from {source}) t)"""


THREE = ("train", "validate", "test")
ORACLES["exact_split"] = f"select doc_id as report_id, split from {split('documents', 'doc_id', 0.6, 0.2, THREE)}"

ORACLES["stratified_folds"] = """
select doc_id, quality, cast(ntile(5) over (partition by quality order by md5(doc_id || ':42'), doc_id) - 1 as integer) as fold
from labels"""
ORACLES["contiguous_folds"] = """
select doc_id as report_id, cast(ntile(5) over (order by doc_id) - 1 as integer) as fold from documents"""

ORACLES["balance_classes"] = """
select doc_id, quality from labels
qualify row_number() over (partition by quality order by md5(doc_id || ':42'), doc_id)
  <= (select min(n) from (select count(*) as n from labels group by quality))"""

ORACLES["split_replay"] = f"""
with parts as {split('labels', 'doc_id', 0.8, None, ('train', 'test'))},
sizes as (select split, min(n) as n from (select split, quality, count(*) as n from parts group by 1, 2) group by 1),
kept as (
  select p.* from parts p join sizes s using (split)
  qualify row_number() over (partition by p.split, quality order by md5(doc_id || ':42'), doc_id) <= s.n)
select d.doc_id, 'multiline_report' || d.doc_id as key, k.split from documents d join kept k using (doc_id)"""


# --- sub-words ----------------------------------------------------------------------------------


def basic(expr: str) -> str:
    return f"regexp_extract_all(regexp_replace({expr}, '{CONTROL}', '', 'g'), '{BASIC_TOKEN}')"


_SPECIAL = ", ".join(f"('{t}', {i})" for i, t in enumerate(SPECIAL))
VOCAB = f"""
bench_words as (select lower(unnest({basic('text')})) as w from benchmark),
top as (select w, count(*) as n from bench_words group by w),
chars as (select distinct unnest(string_split(w, '')) as c from bench_words),
kinds as (
  select t as token, 0 as kind, -i as n from (values {_SPECIAL}) s(t, i)
  union all select c, 1, 0 from chars where c <> ''
  union all select '##' || c, 2, 0 from chars where c <> ''
  union all select w, 3, n from top
  union all select '##' || right(w, 3), 4, sum(n) from top where length(w) > 3 group by 1),
firsts as (select token, min((kind, -n)) as r from kinds group by token),
vocab as (select token, cast(row_number() over (order by r, token) - 1 as integer) as id from firsts)"""

PIECES = f"""
raw_words as (select word, count(*) as n from (select unnest({basic('text')}) as word from documents) group by word),
norms as (select distinct strip_accents(lower(word)) as w from raw_words),
starts as (select w, unnest(range(1, length(w) + 1)) as s from norms where length(w) <= 200),
spans as (select w, s, unnest(range(1, least((select max(length(token)) from vocab), length(w) - s + 1) + 1)) as l from starts),
longest as (
  select w, s, max(l) as l from spans
  where case when s > 1 then '##' else '' end || substr(w, s, l) in (select token from vocab) group by 1, 2),
walk(w, s, l, i) as (
  select w, s, l, 0 from longest where s = 1
  union all
  select n.w, n.s, n.l, p.i + 1 from walk p join longest n on n.w = p.w and n.s = p.s + p.l),
found as (
  select w, list(case when s > 1 then '##' else '' end || substr(w, s, l) order by i) as pieces
  from walk group by w having max(s + l) = length(w) + 1),
matched as (
  select r.word, r.n, coalesce(f.pieces, ['[UNK]']) as pieces
  from raw_words r left join found f on f.w = strip_accents(lower(r.word)))"""

ORACLES["vocabulary"] = f"with {VOCAB} select token, id from vocab"
ORACLES["wordpiece"] = f"""
with recursive {VOCAB}, {PIECES}
select word, n, array_to_string(pieces, ' ') as pieces from matched"""
ORACLES["subtoken_runs"] = f"""
with recursive {VOCAB}, {PIECES}
select array_to_string(pieces, ' ') as run, cast(sum(n) as bigint) as n from matched where len(pieces) > 1 group by 1"""

ORACLES["frequent_runs"] = f"""
with recursive {VOCAB}, {PIECES},
runs as (select array_to_string(pieces, ' ') as run, cast(sum(n) as bigint) as n from matched where len(pieces) > 1 group by 1)
select row_number() over (order by n desc, run) as rank, run, n from runs"""
ORACLES["ordered_index"] = """
select row_number() over (order by cast(o_orderdate as date), o_orderkey) - 1 as position, o_orderkey as report_id,
  o_custkey % (select count(*) from supplier) as ticker, strftime(cast(o_orderdate as date), '%Y-%m-%d') as filing_date
from orders"""


def uniform(text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint)"


MLM = f"""
doc_words as (select doc_id, unnest(l) as word, generate_subscripts(l, 1) as idx
  from (select doc_id, {basic('text')} as l from documents)),
doc_tokens as (
  select d.doc_id, flatten(list(m.pieces order by d.idx)) as tokens from doc_words d join matched m using (word) group by 1),
copies as (
  select *, case when {uniform("doc_id || ':' || dup || ':length:12345'")} < 429496729
    then 2 + {uniform("doc_id || ':' || dup || ':target:12345'")} % 125 else 126 end as t
  from (select doc_id, tokens, unnest(range(5)) as dup from doc_tokens)),
runs as (
  select doc_id, dup, seq_id, ['[CLS]'] || tokens[seq_id * t + 1 : seq_id * t + t] || ['[SEP]'] as original
  from (select *, unnest(range(cast(floor((len(tokens) - 1) / t) as bigint) + 1)) as seq_id from copies)),
seeded as (select *, md5(doc_id || ':' || seq_id || ':' || dup || ':12345') as d from runs),
coded as (
  select * exclude (d), list_transform(range(4), lambda i: cast('0x' || substr(d, 8 * i + 1, 8) as bigint) % 2147483647) as c
  from seeded),
masked as (
  select *, list_sort(list_transform(
      list_sort(list_transform(range(1, len(original) - 1),
        lambda p: ((((c[4] * p + c[3]) % 2147483647) * p + c[2]) % 2147483647 * p + c[1]) % 2147483647 * 4096 + p))
        [1 : cast(least(20, greatest(1, round_even(len(original) * 0.15, 0))) as bigint)],
      lambda r: r % 4096)) as positions
  from coded),
labels as (select *, list_transform(positions, lambda p: original[p + 1]) as masked_labels from masked)"""

_U = uniform("doc_id || ':' || seq_id || ':' || dup || ':' || p || ':replace:12345'") + " % 100"
_V = uniform("doc_id || ':' || seq_id || ':' || dup || ':' || p || ':word:12345'")
ORACLES["mlm_instances"] = f"""
with recursive {VOCAB}, {PIECES}, {MLM},
bag as (select list(token order by id) as words from vocab)
select doc_id as report_id, cast(seq_id as integer) as seq_id, cast(dup as integer) as dup,
  array_to_string(list_transform(range(len(original)), lambda p:
    case when not list_contains(positions, p) then original[p + 1]
         when {_U} < 80 then '[MASK]'
         when {_U} < 90 then original[p + 1]
         else words[{_V} % len(words) + 1] end), ' ') as tokens,
  array_to_string(positions, ' ') as masked_positions, array_to_string(masked_labels, ' ') as masked_labels
from labels, bag"""
_P = "doc_id || ':' || dup || ':' || seq_id || ':"
ORACLES["mlm_pairs"] = f"""
with recursive {VOCAB}, {PIECES},
line_words as (
  select doc_id, line, unnest(w) as word, generate_subscripts(w, 1) as idx
  from (select doc_id, line, {basic('l')} as w from
    (select doc_id, unnest(ls) as l, generate_subscripts(ls, 1) as line from (select doc_id, {lines("coalesce(text, '')")} as ls from documents)))),
line_tokens as (
  select doc_id, line, flatten(list(m.pieces order by idx)) as tokens from line_words join matched m using (word) group by 1, 2),
docs as (
  select doc_id, list(tokens order by line) as sents, list(len(tokens) order by line) as lens, count(*) as n,
    row_number() over (order by md5(doc_id || ':12345'), doc_id) as rank
  from line_tokens where len(tokens) > 0 group by doc_id),
docs_upto as (select *, list_transform(range(1, n + 1), lambda i: list_sum(lens[1:i])) as upto, (select count(*) from docs) as n_docs from docs),
targets as (
  select doc_id, dup, n, upto, case when {uniform("doc_id || ':' || dup || ':length:12345'")} < 429496729
    then 2 + {uniform("doc_id || ':' || dup || ':target:12345'")} % 124 else 125 end as t
  from (select *, unnest(range(5)) as dup from docs_upto)),
ends as (
  select doc_id, dup, n, t, f, least(n, 1 + len(list_filter(upto, lambda u: u < t + case when f > 0 then upto[f] else 0 end))) as l
  from (select *, unnest(range(n)) as f from targets)),
cuts(doc_id, dup, seq_id, f, m, l, t, random) as (
  select doc_id, dup, 0::bigint, f,
    f + case when l - f = 1 then 1 else 1 + {uniform("doc_id || ':' || dup || ':0:split:12345'")} % (l - f - 1) end, l, t,
    l - f = 1 or {uniform("doc_id || ':' || dup || ':0:next:12345'")} % 2 = 0
  from ends where f = 0
  union all
  select e.doc_id, e.dup, c.seq_id + 1, e.f,
    e.f + case when e.l - e.f = 1 then 1 else 1 + {uniform("e.doc_id || ':' || e.dup || ':' || (c.seq_id + 1) || ':split:12345'")} % (e.l - e.f - 1) end, e.l, e.t,
    e.l - e.f = 1 or {uniform("e.doc_id || ':' || e.dup || ':' || (c.seq_id + 1) || ':next:12345'")} % 2 = 0
  from cuts c join ends e on e.doc_id = c.doc_id and e.dup = c.dup and e.f = case when c.random then c.m else c.l end),
drawn as (
  select c.*, flatten(d.sents[f + 1 : m]) as a, d.rank,
    case when not random or n_docs = 1 then d.rank else 1 + {uniform(_P + "partner:12345'")} % (n_docs - 1) end as other
  from cuts c join docs_upto d using (doc_id)),
met as (
  select w.doc_id, dup, seq_id, random, a, greatest(1, t - len(a)) as need, m, l, sents, n,
    {uniform("w.doc_id || ':' || dup || ':' || seq_id || ':at:12345'")} % n as b_at
  from drawn w join (select sents, n, rank as source from docs) d
    on d.source = case when random and other >= w.rank and (select count(*) from docs) > 1 then other + 1 else other end),
sides as (
  select doc_id, dup, seq_id, random, a,
    case when random then flatten(sents[b_at + 1 : b_at + need])[1:need] else flatten(sents[m + 1 : l]) end as b
  from met),
fitted as (
  select *, len(a) as x, len(b) as y, case when len(a) + len(b) <= 125 then len(a) when len(a) <= 62 and len(a) <= len(b) then len(a)
      when len(b) <= 62 then 125 - len(b) else 63 end as ka,
    case when len(a) + len(b) <= 125 then len(b) when len(b) <= 62 and len(b) < len(a) then len(b)
      when len(a) <= 62 then 125 - len(a) else 62 end as kb
  from sides),
runs as (
  select doc_id, dup, seq_id, random, ka, kb, ['[CLS]'] || a[p + 1 : p + ka] || ['[SEP]'] || b[q + 1 : q + kb] || ['[SEP]'] as original
  from (select *, {uniform(_P + "front_a:12345'")} % (x - ka + 1) as p, {uniform(_P + "front_b:12345'")} % (y - kb + 1) as q from fitted)),
seeded as (select *, md5(doc_id || ':' || seq_id || ':' || dup || ':12345') as d from runs),
coded as (
  select * exclude (d), list_transform(range(4), lambda i: cast('0x' || substr(d, 8 * i + 1, 8) as bigint) % 2147483647) as c
  from seeded),
masked as (
  select *, list_sort(list_transform(
      list_sort(list_transform(list_filter(range(1, len(original) - 1), lambda p: p <> ka + 1),
        lambda p: ((((c[4] * p + c[3]) % 2147483647) * p + c[2]) % 2147483647 * p + c[1]) % 2147483647 * 4096 + p))
        [1 : cast(least(20, greatest(1, round_even(len(original) * 0.15, 0))) as bigint)],
      lambda r: r % 4096)) as positions
  from coded),
bag as (select list(token order by id) as words from vocab)
select doc_id as report_id, cast(seq_id as integer) as seq_id, cast(dup as integer) as dup, random as is_random_next,
  array_to_string(list_transform(range(len(original)), lambda p:
    case when not list_contains(positions, p) then original[p + 1]
         when {_U} < 80 then '[MASK]'
         when {_U} < 90 then original[p + 1]
         else words[{_V} % len(words) + 1] end), ' ') as tokens,
  array_to_string(list_transform(range(len(original)), lambda p: case when p < ka + 2 then 0 else 1 end), ' ') as segment_ids,
  array_to_string(positions, ' ') as masked_positions,
  array_to_string(list_transform(positions, lambda p: original[p + 1]), ' ') as masked_labels
from masked, bag"""
ORACLES["oov_rate"] = f"""
with recursive {VOCAB}, {PIECES}, {MLM},
seen as (select token, count(*) as n from (select unnest(masked_labels) as token from labels) group by token)
select count(*) as masked_tokens, count(*) filter (token = '[UNK]') as not_in_vocab_count,
       round(count(*) filter (token = '[UNK]') / count(*), 6) as not_in_vocab_ratio,
       round(sum(n) filter (token = '[UNK]') / sum(n), 6) as unknown_token_rate
from seen"""

FINETUNE = f"""
parts as {split('(select d.doc_id, d.text, l.quality from documents d join labels l using (doc_id)) q', 'doc_id', 0.6, 0.2, THREE)},
part_lines as (
  select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as pos from (select doc_id, {lines('text')} as l from parts)),
{packed(115, False, 'part_lines')},
keyed as (
  select p.split, p.quality as label, k.doc_id || '-' || k.chunk as seq_key, k.text as sequence
  from packed k join parts p using (doc_id)),
least_of as (
  select split, case when count(*) < 2 then 0 else min(n) end as n
  from (select split, label, count(*) as n from keyed group by 1, 2) group by 1),
examples as (
  select k.* from keyed k join least_of o using (split)
  qualify row_number() over (partition by k.split, k.label order by md5(k.seq_key || ':42'), k.seq_key) <= o.n)"""
ORACLES["finetune_set"] = f"with recursive {FINETUNE} select * from examples"
ORACLES["finetune_counts"] = f"with recursive {FINETUNE} select split, count(*) as n_examples from examples group by split"
ORACLES["encode_examples"] = f"""
with recursive {VOCAB}, {PIECES}, {FINETUNE},
numbered as (
  select *, split || '-' || row_number() over (partition by split order by md5(seq_key || ':42'), seq_key) as guid from examples),
seq_words as (
  select guid, unnest(l) as word, generate_subscripts(l, 1) as idx from (select guid, {basic('sequence')} as l from numbered)),
seq_tokens as (
  select guid, flatten(list(m.pieces order by idx))[1:126] as tokens from seq_words join matched m using (word) group by 1),
tokens as (
  select n.guid, n.split, n.label, ['[CLS]'] || coalesce(t.tokens, []) || ['[SEP]'] as tokens
  from numbered n left join seq_tokens t using (guid)),
placed as (select guid, unnest(tokens) as token, generate_subscripts(tokens, 1) as idx from tokens),
coded as (select guid, list(v.id order by idx) as ids from placed p join vocab v using (token) group by 1)
select guid, split, label as label_id,
  array_to_string(ids || list_transform(range(128 - len(ids)), lambda x: 0), ' ') as input_ids,
  array_to_string(list_transform(range(128), lambda x: case when x < len(ids) then 1 else 0 end), ' ') as input_mask,
  array_to_string(list_transform(range(128), lambda x: 0), ' ') as segment_ids
from coded join tokens using (guid)"""

# --- features -----------------------------------------------------------------------------------

ORACLES["pool_mean_std"] = """
with cells as (
  select vec_id // 10 as report_id, generate_subscripts(embedding, 1) - 1 as idx, cast(unnest(embedding) as double) as v from embeddings)
select report_id, cast(idx as integer) as idx, round(avg(v), 6) as value from cells group by report_id, idx
union all
select report_id, cast(idx + 64 as integer), round(stddev_pop(v), 6) from cells group by report_id, idx"""

PARTS = f"""
vectors as (
  select vec_id as report_id, embedding, case when label >= 5 then 1 else 0 end as y,
         case when label >= 5 then 'positive' else 'negative' end as change_nominal from embeddings),
cut as {split('vectors', 'report_id', 0.8, None, ('train', 'test'))},
sizes as (select split, min(n) as n from (select split, y, count(*) as n from cut group by 1, 2) group by 1),
parts as (
  select c.* from cut c join sizes s using (split)
  qualify row_number() over (partition by c.split, y order by md5(report_id || ':42'), report_id) <= s.n),
cells as (
  select report_id, split, y, generate_subscripts(embedding, 1) - 1 as idx, cast(unnest(embedding) as double) as v from parts),
fitted as (
  select idx, avg(v) as m, case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end as s from cells where split = 'train' group by idx),
scaled as (select c.report_id, c.split, c.y, c.idx, (c.v - f.m) / f.s as z from cells c join fitted f using (idx))"""

ORACLES["standardize"] = f"with {PARTS} select report_id, split, cast(idx as integer) as idx, round(z, 6) as value from scaled"
ORACLES["label_encode"] = """
select vec_id as report_id, case when label >= 5 then 'positive' else 'negative' end as change_nominal,
       case when label >= 5 then 1 else 0 end as y from embeddings"""

STEPS = "steps as (select conv_id as report_id, count(*) as n_steps from conversations group by 1)"
ORACLES["steps_hist"] = f"with {STEPS} select n_steps as length, count(*) as occurences from steps group by 1"
ORACLES["longest_report"] = f"with {STEPS} select report_id, n_steps from steps order by n_steps desc, report_id limit 1"
ORACLES["length_batches"] = f"with {STEPS} select report_id, n_steps from steps"

# --- classifiers --------------------------------------------------------------------------------

BAYES = """
smoothing as (select 1e-9 * max(v) as e from (select idx, var_pop(z) as v from scaled where split = 'train' group by idx)),
classes as (
  select y as c, idx, avg(z) as m, var_pop(z) + (select e from smoothing) as v from scaled where split = 'train' group by y, idx),
priors as (
  select y as c, ln(count(*) / (select count(*) from parts where split = 'train')) as p from parts where split = 'train' group by y),
fits as (
  select t.report_id, t.y, k.c, max(p.p) - 0.5 * sum(ln(2 * pi() * k.v) + (t.z - k.m) ** 2 / k.v) as fit
  from scaled t join classes k using (idx) join priors p on p.c = k.c where t.split = 'test' group by 1, 2, 3),
nb as (
  select report_id, y, cast(arg_max(c, fit) as integer) as pred,
         1 / (1 + exp(max(fit) filter (c = 0) - max(fit) filter (c = 1))) as score
  from fits group by 1, 2)"""
KNN = """
rows as (select report_id, split, y, list(z order by idx) as z from scaled group by 1, 2, 3),
near as (
  select a.report_id, a.y, b.y as label from rows a, rows b where a.split = 'test' and b.split = 'train'
  qualify row_number() over (partition by a.report_id order by list_distance(a.z, b.z), b.report_id) <= 15),
knn as (
  select report_id, y, case when sum(label) * 2 > count(*) then 1 else 0 end as pred, sum(label) / count(*) as score
  from near group by 1, 2)"""
ORACLES["nb_predict"] = f"with {PARTS}, {BAYES} select report_id, y, pred, round(score, 6) as score from nb"
ORACLES["knn_predict"] = f"with {PARTS}, {KNN} select report_id, y, pred, round(score, 6) as score from knn"

FOLDED = """
folded as (
  select vec_id as report_id, embedding, case when label >= 5 then 1 else 0 end as y,
         ntile(5) over (partition by label >= 5 order by md5(vec_id || ':42'), vec_id) - 1 as own
  from embeddings)"""
CURVE = """
per_fold as (
  select fold, x, sum(right_one) filter (side = 'train') / count(*) filter (side = 'train') as train,
         sum(right_one) filter (side = 'valid') / count(*) filter (side = 'valid') as valid
  from judged group by fold, x)"""
MEANS = """round(avg(train), 6) as train_scores_mean, round(stddev_pop(train), 6) as train_scores_std,
  round(avg(valid), 6) as valid_scores_mean, round(stddev_pop(valid), 6) as valid_scores_std"""


def sized(fractions: tuple[float, ...]) -> str:
    """Train and validation rows of every (fold, size) cell, scaled by that cell's train part."""
    listed = ", ".join(f"({i}, cast({f!r} as double))" for i, f in enumerate(fractions))
    return f"""
folds as (select unnest(range(5)) as fold),
ranked as (
  select f.fold, d.report_id, row_number() over (partition by f.fold order by md5(report_id || ':42'), report_id) as r
  from folded d join folds f on f.fold <> d.own),
grid as (
  select i, greatest(1, cast(floor(fraction * (select count(*) from ranked where fold = 0)) as bigint)) as x
  from (values {listed}) g(i, fraction)),
members as (
  select r.fold, g.x, r.report_id, 'train' as side from ranked r join grid g on r.r <= g.x
  union all
  select d.own, g.x, d.report_id, 'valid' from folded d, grid g),
cells as (
  select m.fold, m.x, m.side, m.report_id, d.y, generate_subscripts(d.embedding, 1) as idx, cast(unnest(d.embedding) as double) as v
  from members m join folded d using (report_id)),
fitted as (
  select fold, x, idx, avg(v) as m, case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end as s
  from cells where side = 'train' group by 1, 2, 3),
scaled as (select c.fold, c.x, c.side, c.report_id, c.y, c.idx, (c.v - f.m) / f.s as z from cells c join fitted f using (fold, x, idx))"""


ORACLES["nb_learning_curve"] = f"""
with {FOLDED}, {sized(NB_SIZES)},
smoothing as (
  select fold, x, 1e-9 * max(v) as e from
    (select fold, x, idx, var_pop(z) as v from scaled where side = 'train' group by 1, 2, 3) group by 1, 2),
classes as (
  select s.fold, s.x, s.y as c, s.idx, avg(z) as m, var_pop(z) + max(e) as v
  from scaled s join smoothing using (fold, x) where side = 'train' group by 1, 2, 3, 4),
priors as (
  select fold, x, y as c, ln(count(*) / sum(count(*)) over (partition by fold, x)) as p
  from scaled where side = 'train' and idx = 1 group by 1, 2, 3),
fits as (
  select t.fold, t.x, t.side, t.report_id, t.y, k.c, max(p.p) - 0.5 * sum(ln(2 * pi() * k.v) + (t.z - k.m) ** 2 / k.v) as fit
  from scaled t join classes k using (fold, x, idx) join priors p on p.fold = k.fold and p.x = k.x and p.c = k.c
  group by 1, 2, 3, 4, 5, 6),
judged as (
  select fold, x, side, report_id, case when arg_max(c, fit) = any_value(y) then 1 else 0 end as right_one from fits group by 1, 2, 3, 4),
{CURVE}
select x as train_sizes, {MEANS} from per_fold group by x"""

ORACLES["knn_learning_curve"] = f"""
with {FOLDED}, {sized(SIZES)},
rows as (select fold, x, side, report_id, y, list(z order by idx) as z from scaled group by 1, 2, 3, 4, 5),
near as (
  select a.fold, a.x, a.side, a.report_id, a.y, b.y as label
  from rows a join rows b on a.fold = b.fold and a.x = b.x and b.side = 'train'
  qualify row_number() over (partition by a.fold, a.x, a.side, a.report_id order by list_distance(a.z, b.z), b.report_id) <= 15),
judged as (
  select fold, x, side, report_id, case when (sum(label) * 2 > count(*)) = (any_value(y) = 1) then 1 else 0 end as right_one
  from near group by 1, 2, 3, 4),
{CURVE}
select x as train_sizes, {MEANS} from per_fold group by x"""

ORACLES["knn_validation_curve"] = f"""
with {FOLDED},
folds as (select unnest(range(5)) as fold),
cells as (
  select f.fold, d.report_id, d.y, d.own, generate_subscripts(d.embedding, 1) as idx, cast(unnest(d.embedding) as double) as v
  from folded d, folds f),
fitted as (
  select fold, idx, avg(v) as m, case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end as s
  from cells where own <> fold group by 1, 2),
rows as (
  select c.fold, c.report_id, c.y, case when c.own = c.fold then 'valid' else 'train' end as side,
         list((c.v - f.m) / f.s order by c.idx) as z
  from cells c join fitted f using (fold, idx) group by 1, 2, 3, 4),
near as (
  select a.fold, a.side, a.report_id, a.y, b.y as label,
         row_number() over (partition by a.fold, a.report_id order by list_distance(a.z, b.z), b.report_id) as r
  from rows a join rows b on a.fold = b.fold and b.side = 'train'),
votes as (
  select fold, side, y, r as x, sum(label) over (partition by fold, report_id order by r) as ones
  from near where r <= 349),
judged as (
  select fold, side, x, case when (ones * 2 > x) = (y = 1) then 1 else 0 end as right_one from votes where x % 2 = 1 and x >= 3),
{CURVE}
select x as n_neighbors, {MEANS} from per_fold group by x"""

ORACLES["epoch_curve"] = f"""
with per_fold as (
  select hour(ts) as epoch, user_id % 5 as fold, avg(value / 500) filter (event_id % 2 = 0) as train,
         avg(value / 500) filter (event_id % 2 = 1) as valid
  from events group by 1, 2)
select cast(epoch as integer) as epochs, {MEANS} from per_fold group by 1"""

# --- evaluation ---------------------------------------------------------------------------------

ORACLES["confusion_matrix"] = f"""
with {PARTS}, {BAYES}
select cast(a as integer) as y, cast(b as integer) as pred, count(nb.y) as n
from range(2) t(a), range(2) u(b) left join nb on nb.y = a and nb.pred = b group by 1, 2"""

_PER_CLASS = """
per_class as (
  select c as label, count(*) filter (y = c and pred = c) as tp, count(*) filter (pred = c) as said, count(*) filter (y = c) as support,
         count(*) as total
  from nb, range(2) t(c) group by c),
rated as (
  select *, coalesce(tp / nullif(said, 0), 0) as p, coalesce(tp / nullif(support, 0), 0) as r,
         coalesce(2 * tp / nullif(said + support, 0), 0) as f from per_class)"""
ORACLES["class_report"] = f"""
with {PARTS}, {BAYES}, {_PER_CLASS}
select cast(label as varchar) as label, round(p, 4) as precision, round(r, 4) as recall, round(f, 4) as f1_score, support from rated
union all
select 'accuracy', round(sum(tp) / max(total), 4), round(sum(tp) / max(total), 4), round(sum(tp) / max(total), 4), max(total) from rated
union all
select 'macro avg', round(avg(p), 4), round(avg(r), 4), round(avg(f), 4), max(total) from rated
union all
select 'weighted avg', round(sum(p * support) / max(total), 4), round(sum(r * support) / max(total), 4),
       round(sum(f * support) / max(total), 4), max(total) from rated"""

_STEPS_OF_SCORES = """
groups as (select score, sum(y) as pos, count(*) - sum(y) as neg from knn group by score),
running as (
  select *, sum(pos) over down as tp, sum(neg) over down as fp, sum(pos) over () as all_pos, sum(neg) over () as all_neg,
         lead(pos) over down as next_pos, lead(neg) over down as next_neg, row_number() over down as i
  from groups window down as (order by score desc))"""
ORACLES["roc_points"] = f"""
with {PARTS}, {KNN}, {_STEPS_OF_SCORES}
select round(score, 6) as threshold, round(fp / all_neg, 6) as fpr, round(tp / all_pos, 6) as tpr from running
where i = 1 or next_pos is null or next_pos <> pos or next_neg <> neg
union all select round(max(score) + 1, 6), 0.0, 0.0 from knn"""
ORACLES["auc"] = f"""
with {PARTS}, {KNN}, {_STEPS_OF_SCORES},
curve as (
  select fp / all_neg as x, tp / all_pos as t, coalesce(lag(fp / all_neg) over (order by score desc), 0) as x0,
         coalesce(lag(tp / all_pos) over (order by score desc), 0) as t0 from running)
select round(sum((x - x0) * (t + t0) / 2), 6) as auc from curve"""


def company(source: str) -> str:
    return f"""
company as (
  select cik, min_by(ticker, (split <> 'train', report_id)) as ticker, min_by(name, (split <> 'train', report_id)) as name,
         count(*) filter (split = 'train' and change_nominal = 'positive') as train_positives,
         count(*) filter (split = 'train' and change_nominal <> 'positive') as train_negatives,
         count(*) filter (split = 'test' and change_nominal = 'positive') as test_positives,
         count(*) filter (split = 'test' and change_nominal <> 'positive') as test_negatives
  from {source} group by cik),
drift as (
  select *, train_positives / nullif(train_positives + train_negatives, 0) as train_positive_ratio,
    (train_positives * test_positives + train_negatives * test_negatives)
      / nullif(sqrt(train_positives ** 2 + train_negatives ** 2) * sqrt(test_positives ** 2 + test_negatives ** 2), 0)
      as cosine_similarity_train_test
  from company)"""


_COUNTS = """cik, ticker, name, train_positives, train_negatives, round(train_positive_ratio, 6) as train_positive_ratio,
  test_positives, test_negatives, round(cosine_similarity_train_test, 6) as cosine_similarity_train_test"""
_NAMED = """
named as (
  select *, report_id % 40 as cik, 'T' || (report_id % 40) as ticker, 'Company ' || (report_id % 80) as name from parts)"""

def predictions(m: str) -> str:
    return f"""
{m}_by_company as (
  select report_id % 40 as cik, count(*) filter (pred = 1) as {m}_up, count(*) filter (pred <> 1) as {m}_down,
         count(*) filter (pred = 1 and y = 1) / count(*) as {m}_acc, count(*) filter (pred = y) / count(*) as {m}_true
  from {m} group by 1)"""


_MODEL_COLUMNS = ", ".join(
    f"coalesce({m}_up, 0) as {m}_test_pred_positives, coalesce({m}_down, 0) as {m}_test_pred_negatives, "
    f"round({m}_acc, 6) as {m}_accuracy, round({m}_true, 6) as {m}_true_accuracy"
    for m in ("nb", "knn")
)
ORACLES["company_drift"] = f"""
with {PARTS}, {BAYES}, {KNN}, {_NAMED}, {company('named')}, {predictions('nb')}, {predictions('knn')}
select {_COUNTS}, {_MODEL_COLUMNS}
from drift left join nb_by_company using (cik) left join knn_by_company using (cik)"""
ORACLES["similarity_points"] = f"""
with {PARTS}, {BAYES}, {_NAMED}, {company('named')}, {predictions('nb')}
select cik, round(cosine_similarity_train_test, 6) as cosine_similarity_train_test, round(nb_acc, 6) as nb_accuracy
from drift join nb_by_company using (cik) where cosine_similarity_train_test is not null"""
ORACLES["company_direction_counts"] = f"""
with {REPORTS}, {TRADING_DAY}, {LABELLED},
parts as {split("(select *, 'Customer ' || cik as name from labelled) q", 'report_id', 0.8, None, ('train', 'test'))},
{company('parts')}
select {_COUNTS} from drift"""

# --- sinks and streams --------------------------------------------------------------------------

ORACLES["lines_by_word_count"] = f"with {DOC_LINES} select {words('line')} as words_in_sequence, line from doc_lines"
ORACLES["price_insert"] = f"""
with {TRADING_DAY} select ticker, strftime(date, '%Y-%m-%d') as date, open, close from trading_day"""
ORACLES["corpus_metrics"] = f"""
with counted as (select {words('text')} as n from documents)
select 'corpus' as job, unnest(['n_documents', 'n_words', 'most_words']) as metric,
       unnest([cast(count(*) as varchar), cast(cast(sum(n) as bigint) as varchar), cast(max(n) as varchar)]) as value from counted"""
ORACLES["stream_clean"] = f"""
with body as (select doc_id as report_id, {HEADER.format(unix('text'))} as t from documents),
flat as (select report_id, {single_line(EXHIBIT.format('t'))} as t from body),
cut as (select report_id, list_filter({sentences('t')}, lambda s: {meaningful('s')}) as s from flat)
select report_id, cast(generate_subscripts(s, 1) - 1 as integer) as pos, unnest(s) as sentence from cut"""
ORACLES["stream_prices"] = ORACLES["json_series_parse"]
ORACLES["stream_labels"] = ORACLES["label_price_change"].replace(
    "select report_id, ticker, strftime(filing_date, '%Y-%m-%d') as filing_date, form_type,", "select report_id, ticker,"
)

# --- keys, paths and step tables ----------------------------------------------------------------

ORACLES["file_paths"] = """
select doc_id, './data/Edgar/' || source || '/multiline_report' || doc_id || '.txt' as path,
       'multiline_report' || doc_id as key, 'multiline_report' || doc_id || '.txt' as name from documents"""
ORACLES["mean_features"] = """
with cells as (
  select vec_id // 10 as report_id, generate_subscripts(embedding, 1) - 1 as idx, cast(unnest(embedding) as double) as v from embeddings)
select report_id, cast(idx as integer) as idx, round(avg(v), 6) as value from cells group by report_id, idx"""
ORACLES["scaled_steps"] = f"""
with reports as (select distinct vec_id // 10 as report_id from embeddings),
parts as {split('reports', 'report_id', 0.8, None, ('train', 'test'))},
cells as (
  select vec_id // 10 as report_id, cast(vec_id % 10 as integer) as step, generate_subscripts(embedding, 1) - 1 as idx,
         cast(unnest(embedding) as double) as v from embeddings),
placed as (select c.*, p.split from cells c join parts p using (report_id)),
fitted as (
  select idx, avg(v) as m, case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end as s from placed where split = 'train' group by idx)
select p.report_id, p.split, p.step, cast(p.idx as integer) as idx, round((p.v - f.m) / f.s, 6) as value
from placed p join fitted f using (idx)"""
ORACLES["sequence_total"] = "select count(*) as n_sequences from embeddings"

# --- kernel machine: weights, features and descent rebuilt ---------------------------------------

RFF_WIDTH, RFF_GAMMA, RFF_STEPS = 16, 0.01, 12


def _uniform(name: str) -> str:
    return f"((cast('0x' || substr(md5({name}), 1, 13) as bigint)::double + 0.5::double) / 4503599627370496::double)"


RFF = f"""
directions as (
  select i, j, sqrt(-2 * ln({_uniform("'42:r:' || i || ':' || j")})) * cos(2 * pi() * {_uniform("'42:a:' || i || ':' || j")}) as w
  from range(64) a(i), range({RFF_WIDTH}) b(j)),
phases as (select j, 2 * pi() * {_uniform("'42:b:' || j")} as b from range({RFF_WIDTH}) t(j))"""


def _lifted(source: str, columns: str) -> str:
    """Fourier features of ``source (columns, idx, z)``."""
    return f"""
  select {columns}, p.j, sqrt(2.0::double / {RFF_WIDTH}) * cos(sqrt(2 * {RFF_GAMMA}::double) * x.dot + p.b) as z
  from (select {columns}, d.j, sum(s.z * d.w) as dot from {source} s join directions d on d.i = s.idx group by {columns}, d.j) x
  join phases p on p.j = x.j"""


ORACLES["rff_lift"] = f"""
with cells as (
  select vec_id as report_id, generate_subscripts(embedding, 1) - 1 as idx, cast(unnest(embedding) as double) as v from embeddings),
fitted as (select idx, avg(v) as m, case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end as s from cells group by idx),
scaled as (select c.report_id, c.idx, (c.v - f.m) / f.s as z from cells c join fitted f using (idx)), {RFF},
lifted as ({_lifted('scaled', 'report_id')})
select report_id, cast(j as integer) as at, round(z, 6) + 0::double as value from lifted"""


def _descent() -> str:
    steps = [f"w0 as (select j, 0::double as now, 0::double as before from range({RFF_WIDTH} + 1) t(j))"]
    for t in range(RFF_STEPS):
        steps.append(f"""
a{t} as materialized (select j, now, now + {t}::double / {t + 3} * (now - before) as ahead from w{t}),
s{t} as materialized (
  select r.report_id, any_value(r.sign) as sign, greatest(0, 1 - any_value(r.sign) * sum(r.z * a.ahead)) as slack
  from train r join a{t} a using (j) group by r.report_id),
w{t + 1} as materialized (
  select a.j, a.ahead - 1 / (6 + 1 / n.n) * (g.g / n.n + case when a.j < {RFF_WIDTH} then a.ahead / n.n else 0 end) as now,
         a.now as before
  from a{t} a join (select r.j, sum(-2 * s.sign * s.slack * r.z) as g from train r join s{t} s using (report_id) group by r.j) g using (j),
       n)""")
    return ",".join(steps)


ORACLES["svm_margin"] = f"""
with {PARTS}, {RFF},
lifted as materialized ({_lifted('scaled', 'report_id, split, y')}
  union all select report_id, split, y, {RFF_WIDTH}, 1::double from parts),
train as materialized (select report_id, j, z, case when y = 1 then 1::double else -1::double end as sign from lifted where split = 'train'),
n as materialized (select count(*)::double as n from parts where split = 'train'), {_descent()},
margins as (
  select l.report_id, l.y, sum(l.z * w.now) as margin from lifted l join w{RFF_STEPS} w using (j)
  where l.split = 'test' group by 1, 2)
select report_id, y, cast(margin > 0 as integer) as pred, round(margin, 6) as margin from margins"""

# --- principal components by power iteration ------------------------------------------------------


def _power(name: str, matrix: str) -> str:
    """A thousand steps from 1, 1/2, 1/3, ..., then the sign by the largest loading."""
    return f"""
{name}_steps as (
  select 0 as t, list_transform(range(1, 65), lambda i: 1 / i::double) as v
  union all
  select t + 1, list_transform(y, lambda e: e / sqrt(list_dot_product(y, y)))
  from (select s.t, list_transform(m.m, lambda r: list_dot_product(r, s.v)) as y from {name}_steps s, {matrix} m where s.t < 1000)),
{name} as materialized (
  select list_transform(v, lambda e: e * sign(v[list_position(a, list_max(a))])) as v
  from (select v, list_transform(v, lambda e: abs(e)) as a from {name}_steps where t = 1000))"""


ORACLES["pca_points"] = f"""
with recursive cells as (
  select vec_id as report_id, label, generate_subscripts(embedding, 1) - 1 as idx, cast(unnest(embedding) as double) as v from embeddings),
fitted as (select idx, avg(v) as m, case when stddev_pop(v) = 0 then 1 else stddev_pop(v) end as s from cells group by idx),
scaled as materialized (
  select c.report_id, c.label, list((c.v - f.m) / f.s order by c.idx) as z from cells c join fitted f using (idx) group by 1, 2),
flat as (select report_id, generate_subscripts(z, 1) as idx, unnest(z) as z from scaled),
cov as (select a.idx as i, b.idx as j, covar_pop(a.z, b.z) as c from flat a join flat b using (report_id) group by 1, 2),
first_matrix as materialized (select list(r order by i) as m from (select i, list(c order by j) as r from cov group by i)),
{_power('first_axis', 'first_matrix')},
second_matrix as materialized (
  select list_transform(m.m, lambda r, i: list_transform(r, lambda c, j: c - m.size * m.v[i] * m.v[j])) as m
  from (select m, v, list_dot_product(v, list_transform(m, lambda r: list_dot_product(r, v))) as size
        from first_matrix, first_axis) m),
{_power('second_axis', 'second_matrix')}
select s.report_id, case when s.label >= 5 then 'positive' else 'negative' end as change_nominal,
       round(list_dot_product(s.z, a.v), 6) + 0::double as pc1, round(list_dot_product(s.z, b.v), 6) + 0::double as pc2
from scaled s, first_axis a, second_axis b"""

# --- embedding by a seeded projection of hashed words ---------------------------------------------

ORACLES["embed_hook"] = f"""
with recursive {DOC_LINES}, {packed(460, True)},
words as (
  select doc_id, chunk, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) as word from packed),
hashed as (
  select doc_id, chunk, cast('0x' || substr(md5(word), 1, 8) as bigint) % 1024 as b, count(*) as n from words group by 1, 2, 3),
totals as (select doc_id, chunk, sum(n) as n from hashed group by 1, 2),
weights as materialized (select b, j, 2 * {_uniform("'42:' || b || ':' || j")} - 1 as w from range(1024) x(b), range(32) y(j)),
sums as (select h.doc_id, h.chunk, w.j, sum(h.n * w.w) as s from hashed h join weights w using (b) group by 1, 2, 3)
select c.doc_id as report_id, cast(c.chunk as integer) as step, cast(j.j as integer) as at,
       coalesce(round(s.s / t.n, 6), 0) + 0::double as value
from packed c cross join range(32) j(j) left join sums s on s.doc_id = c.doc_id and s.chunk = c.chunk and s.j = j.j
left join totals t on t.doc_id = c.doc_id and t.chunk = c.chunk"""
