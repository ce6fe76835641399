"""Common parts of the comparison SQL."""

C = "c as (select distinct on (hash) hash, project_id, author_id, commit_ts, message, insertions, deletions, is_squash_suspected, committer_email, committer_name, synced_at from commits where hash is not null order by hash, (committer_email is not null) desc, synced_at desc)"
A = "a as (select distinct on (id) id, name, email, name_variants, canonical_author_id from authors where id is not null order by id, name nulls first, email nulls first, name_variants nulls first, canonical_author_id nulls first)"
P = "p as (select distinct on (id) * from projects where id is not null)"
K = "k as (select distinct on (id) * from courses where id is not null)"
TREE = """n0 as (select id, min(canonical_author_id) as link from authors where id is not null group by id),
m0 as (select n0.id, b.id as parent from n0 left join n0 b on n0.link = b.id),
up as (select id, id as root_id from m0 where parent is null union all select m0.id, up.root_id from m0 join up on m0.parent = up.id),
canon as (select m0.id as author_id, coalesce(up.root_id, m0.id) as root_id from m0 left join up on up.id = m0.id)"""
CR = "cr as (select c.*, coalesce(canon.root_id, c.author_id) as root_id from c left join canon using (author_id))"
FOLD = f"with recursive {C}, {TREE}, {CR}"
D = f"{C}, {P}, {K}, d as (select c.*, k.deadline from c left join p on p.id = c.project_id left join k on k.id = p.course_id)"
PATH = r"regexp_replace(replace({0}, chr(92), '/'), '^/+', '')"
BASE = "regexp_extract(" + PATH + ", '([^/]*)$', 1)"
EXT = "lower(regexp_extract(" + BASE + r", '^.+(\.[^.]*)$', 1))"


def changes(*cols: str) -> str:
    return "f as (select distinct on (id) id, " + ", ".join(cols) + " from file_changes where id is not null order by id, " + ", ".join(f"{c} nulls first" for c in cols) + ")"


def case(table: dict[str, str], e: str) -> str:
    return f"case {e} " + " ".join(f"when '{k}' then '{v}'" for k, v in table.items()) + " end"


def strings(xs) -> str:
    return "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + ")"
