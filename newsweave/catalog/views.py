"""Adapter views as DuckDB SQL: the oracle's side of ``sources.sample``."""

from __future__ import annotations

AS_OF = "timestamp '2024-01-15 12:00:00'"

VIEWS = {
    "topic_dim": ((), """select * from (values (0,'AI & ML'),(1,'Cybersecurity & Privacy'),(2,'Cloud Computing & DevOps'),
 (3,'Software Development & Web Technologies'),(4,'Emerging Technologies'),(5,'Big Tech & Industry Trends'),
 (6,'Tech Culture & Work'),(7,'Open Source')) t(k,topic)"""),
    "sources": ((), """select distinct cast(substr(source,4) as int) as id, source as source_name,
 concat('https://',source,'.example.com/feed') as feed_url from documents"""),
    "content": (("topic_dim",), """select d.doc_id as id, cast(substr(d.source,4) as int) as source_id,
 substr(split_part(d.text,'.',1),1,255) as title, d.text as summary,
 concat('https://',d.source,'.example.com/a/',cast(d.doc_id as varchar(20))) as article_url,
 case when d.doc_id % 50 = 49 then null else e.ts end as published_at, t.topic as topic,
 case when d.doc_id % 3 = 0 then null else concat('https://cdn.example.com/',cast(d.doc_id as varchar(20)),'.jpg') end as image_url
 from documents d left join events e on e.event_id = d.doc_id * 5 left join topic_dim t on t.k = d.doc_id % 9"""),
    "interaction_log": ((), """select e.event_id, e.user_id, e.event_id % n.n as content_id,
 case when event_type in ('view','click') then true when event_type='error' then false end as is_read,
 case when event_type='purchase' then true when event_type='signup' then false end as is_liked, e.ts as interaction_at
 from events e cross join (select count(*) as n from documents) n"""),
    "interactions": (("interaction_log",), """select user_id, content_id,
 coalesce(arg_max(is_read, row(interaction_at,event_id)) filter (where is_read is not null), false) as is_read,
 coalesce(arg_max(is_liked, row(interaction_at,event_id)) filter (where is_liked is not null), false) as is_liked,
 max(interaction_at) as interaction_at
 from interaction_log where is_read is not null or is_liked is not null group by user_id, content_id"""),
    "users": ((), "select distinct user_id from events"),
    "user_topics": (("topic_dim",), """select distinct u.user_id, t.topic from (select distinct user_id from events) u
 join topic_dim t on (t.k = u.user_id % 8 or t.k = (u.user_id*3+1) % 8) where u.user_id % 10 <> 0"""),
    "feed_items": (("topic_dim",), """select cast(substr(d.source,4) as int) as source_id, d.source as source_name,
 row_number() over (partition by d.source order by d.doc_id desc) - 1 as pos,
 concat('https://news.example.com/a/', cast(case when d.doc_id % 5 = 0 then d.doc_id + 1 else d.doc_id end as varchar(20))) as link,
 split_part(d.text,'.',1) as title, d.text as summary, t.topic as topic, d.doc_id as doc_id
 from documents d left join topic_dim t on t.k = d.doc_id % 9"""),
    "stored": (("feed_items",), "select distinct link as article_url from feed_items where doc_id % 4 = 0"),
    "url_status": (("feed_items",), "select link as url, max(case when doc_id % 11 = 0 then 404 else 200 end) as status from feed_items group by link"),
    "likes": (("interactions",), "select distinct content_id from interactions where is_liked"),
    "touches": (("interactions",), "select content_id, count(*) as n, count(*) filter (where is_read) as reads from interactions group by content_id"),
    "articles": (("content", "sources"), "select c.*, s.source_name, s.feed_url as source_feed_url from content c join sources s on s.id = c.source_id"),
}


def needed(names) -> list[str]:
    """Views in dependency order."""
    order: list[str] = []

    def visit(name):
        for below in VIEWS[name][0]:
            visit(below)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    return order


def sql(names: str, body: str, **views: str) -> str:
    """``body`` behind the named adapter views (space separated) and any extra ``views``."""
    parts = [f"{n} as ({VIEWS[n][1]})" for n in needed(names.split())]
    parts += [f"{n} as ({text})" for n, text in views.items()]
    return f"with {', '.join(parts)} {body}" if parts else body
