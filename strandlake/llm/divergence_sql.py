"""The source divergence audit as one SQL query."""

SQL = r"""with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
t as (select r, lang, source, unnest(ws) as term from d),
c as (select lang, source, term, count(*) as n from t group by all),
k as (select lang, term from t group by all having count(distinct r) >= 10),
s as (select distinct lang, source from d),
g as (select s.lang, s.source, k.term, coalesce(c.n, 0) as n, count(*) over (partition by s.lang, s.source) as kept, sum(coalesce(c.n, 0)) over (partition by s.lang, s.source) as total from s join k on s.lang = k.lang left join c on c.lang = s.lang and c.source = s.source and c.term = k.term),
p as (select *, 1 + (1000000000::hugeint * (n + 2)) // (total + 2 * kept)::hugeint as share from g),
l as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 2)) // (any_value(whole) + 2 * any_value(kept))::hugeint as share from (select *, sum(n) over (partition by lang) as whole from g) group by all),
v as (select a.lang, a.source, 'pair' as part, b.source as item, sum(((a.share - b.share) * (a.share - b.share)) // (a.share + b.share)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
union all select a.lang, a.source, 'pair', b.source, 0 from s a join s b on a.lang = b.lang and a.source <> b.source where a.lang not in (select lang from k)
union all select p.lang, p.source, 'term', p.term, ((p.share - l.share) * (p.share - l.share)) // (p.share + l.share) from p join l on p.lang = l.lang and p.term = l.term where p.n > 0 and p.share > l.share),
o as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from v)
select lang, source, part, item, value::bigint as value, rank::int as rank from o where part = 'pair' or rank <= 10"""
