"""Named services: what each lists, how it pages, how far, and what of an answer is kept.

A service is a generator over ``call``, any client's ``call(address, parameters) -> parsed JSON``, so that pages are asked
for only as far as ``limit`` needs. ``read`` runs one generator for each task on the executors: tasks are repositories,
channels, collections, queries or spaces. A task that fails becomes one row that says so; its earlier rows stay.
"""

from __future__ import annotations

import email
import email.policy
import json
import re
from collections.abc import Callable, Iterator
from html import unescape
from itertools import islice
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Call = Callable[[str, dict[str, Any]], Any]
Item = tuple[str, str, dict[str, Any]]
#: A service's items are (source, text, facts).
Service = Callable[[Call, dict[str, Any]], Iterator[Item]]
SCHEMA = "task string, source string, content string, meta map<string,string>, success boolean, error string"


def github_code(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """Files of a repository, breadth first from ``path``, of the ``extensions`` asked for."""
    root = f"https://api.github.com/repos/{task['repo']}/contents/"
    extensions = tuple(task.get("extensions") or ())
    waiting = [str(task.get("path") or "")]
    while waiting:
        found = call(root + waiting.pop(0), {})
        for entry in found if isinstance(found, list) else [found]:
            if entry["type"] == "dir":
                waiting.append(entry["path"])
            elif not extensions or entry["path"].endswith(extensions):
                text = call(entry.get("download_url") or root + entry["path"], {})
                yield entry["path"], text if isinstance(text, str) else json.dumps(text), {"sha": entry.get("sha")}


def github_issues(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """Issues, without pull requests, in the ``state`` asked for."""
    for x in _numbered(call, f"https://api.github.com/repos/{task['repo']}/issues", {"state": task.get("state") or "open", "per_page": 100}, "page", None):
        if "pull_request" not in x:
            yield x["html_url"], f"# {x['title']}\n\n{x.get('body') or ''}".strip(), {"number": x.get("number"), "state": x.get("state")}


def mongodb(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """Documents of a collection that match ``query``; ``call`` is find(collection, {filter, limit})."""
    for doc in call(task["collection"], {"filter": task.get("query") or {}, "limit": task.get("limit") or 5000}):
        yield f"{task['collection']}/{doc.get('_id')}", json.dumps({k: v for k, v in doc.items() if k != "_id"}, default=str, ensure_ascii=False), {"_id": doc.get("_id")}


def rss(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """Entries of a feed, RSS or Atom, as Markdown: the full text, else the summary."""
    for e in feed_entries(call(task["url"], {})):
        body = readable(e["content"] or e["summary"])
        yield e["link"], f"# {e['title']}\n\n{body}".strip(), {"title": e["title"], "published": e["published"]}


def web_page(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """The readable part of a page as Markdown."""
    html = call(task["url"], {})
    yield task["url"], readable(html), {"title": _title(html)}


def wikipedia(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """The plain text of an article in ``lang``."""
    lang = task.get("lang") or "ko"
    found = call(f"https://{lang}.wikipedia.org/w/api.php", {"action": "query", "prop": "extracts", "explaintext": 1, "redirects": 1, "format": "json", "titles": task["title"]})
    for p in found["query"]["pages"].values():
        if p.get("extract"):
            yield f"https://{lang}.wikipedia.org/wiki/{p['title'].replace(' ', '_')}", f"# {p['title']}\n\n{p['extract']}", {"pageid": p.get("pageid"), "lang": lang}


def transcript(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """A video's transcript, a row for each line with its start and duration."""
    for i, line in enumerate(call(task["video"], {})):
        yield f"https://www.youtube.com/watch?v={task['video']}", line["text"], {"ord": i, "start": line["start"], "duration": line["duration"]}


def playlist(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """Videos of a list: ``liked``, ``uploads`` or a list's id."""
    target = task.get("target") or "liked"
    if target in ("liked", "uploads"):
        lists = call("https://www.googleapis.com/youtube/v3/channels", {"part": "contentDetails", "mine": "true"})["items"][0]["contentDetails"]["relatedPlaylists"]
        target = lists["likes" if target == "liked" else "uploads"]
    for x in _tokened(call, "https://www.googleapis.com/youtube/v3/playlistItems", {"part": "snippet", "playlistId": target, "maxResults": 50}, "items"):
        s = x["snippet"]
        yield f"https://www.youtube.com/watch?v={s['resourceId']['videoId']}", f"# {s['title']}\n\n{s.get('description') or ''}".strip(), {"published": s.get("publishedAt")}


def drive(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """Files of a folder; the service's own documents are exported as text, sheets as CSV."""
    query = f"'{task['folder']}' in parents and trashed = false" if task.get("folder") else "trashed = false"
    kinds = {"application/vnd.google-apps.document": "text/plain", "application/vnd.google-apps.presentation": "text/plain", "application/vnd.google-apps.spreadsheet": "text/csv"}
    for f in _tokened(call, "https://www.googleapis.com/drive/v3/files", {"q": query, "fields": "nextPageToken,files(id,name,mimeType)", "pageSize": 100}, "files"):
        address = f"https://www.googleapis.com/drive/v3/files/{f['id']}"
        if f["mimeType"] == "application/vnd.google-apps.folder":
            continue
        text = call(f"{address}/export", {"mimeType": kinds[f["mimeType"]]}) if f["mimeType"] in kinds else call(address, {"alt": "media"})
        yield address, text if isinstance(text, str) else bytes(text).decode("utf-8", "replace"), {"name": f["name"], "mime": f["mimeType"]}


def mail(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """The newest messages of a search; ``call`` lists ids in order and gives a message's bytes for an id."""
    ids = call("search", {"folder": task.get("folder") or "INBOX", "criteria": task.get("query") or "ALL"})
    for i in reversed(ids):
        m = message(call("fetch", {"id": i}))
        yield f"mail:{i}", m.pop("body"), m


def slack(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """Messages of a channel, each with its thread's replies."""
    for x in _cursored(call, "https://slack.com/api/conversations.history", {"channel": task["channel"], "limit": 100}, "messages"):
        lines = [x.get("text") or ""]
        if x.get("reply_count"):
            replies = _cursored(call, "https://slack.com/api/conversations.replies", {"channel": task["channel"], "ts": x["ts"], "limit": 100}, "messages")
            lines += [f"- **{r.get('user')}**: {r.get('text') or ''}" for r in replies if r["ts"] != x["ts"]]
        yield f"slack:{task['channel']}:{x['ts']}", "\n".join(lines), {"user": x.get("user"), "ts": x["ts"]}


def discord(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """Messages of a channel, the newest first."""
    before = None
    while True:
        found = call(f"https://discord.com/api/v10/channels/{task['channel']}/messages", {"limit": 100} | ({"before": before} if before else {}))
        for x in found:
            yield f"discord:{task['channel']}:{x['id']}", x.get("content") or "", {"author": (x.get("author") or {}).get("username"), "timestamp": x.get("timestamp")}
        if not found:
            return
        before = found[-1]["id"]


def jira(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """Issues of a project or of a JQL query, the newest first."""
    jql = task.get("jql") or f"project = \"{task['project']}\" ORDER BY created DESC"
    for x in _offset(call, f"{task['base']}/rest/api/2/search", {"jql": jql, "maxResults": 50}, "startAt", "issues"):
        f = x["fields"]
        yield f"{task['base']}/browse/{x['key']}", f"# {x['key']}: {f['summary']}\n\n{f.get('description') or ''}".strip(), {"status": (f.get("status") or {}).get("name"), "created": f.get("created")}


def confluence(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """Pages of a space or of a CQL query, the newest first."""
    cql = task.get("cql") or f"space = \"{task['space']}\" AND type = page ORDER BY created DESC"
    for x in _offset(call, f"{task['base']}/rest/api/content/search", {"cql": cql, "limit": 25, "expand": "body.storage"}, "start", "results"):
        yield f"{task['base']}/pages/{x['id']}", f"# {x['title']}\n\n{readable(x['body']['storage']['value'])}".strip(), {"id": x["id"]}


_NOTION = {"heading_1": "# ", "heading_2": "## ", "heading_3": "### ", "bulleted_list_item": "- ", "numbered_list_item": "1. ", "quote": "> ", "paragraph": ""}


def notion(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """A page, or the pages of a database, with blocks within blocks as indented Markdown."""

    def lines(block: str, depth: int) -> Iterator[str]:
        for b in _cursored(call, f"https://api.notion.com/v1/blocks/{block}/children", {"page_size": 100}, "results"):
            kind = b["type"]
            text = "".join(t["plain_text"] for t in b[kind].get("rich_text", []))
            mark = f"- [{'x' if b[kind].get('checked') else ' '}] " if kind == "to_do" else _NOTION.get(kind, "")
            if kind == "code":
                yield f"```{b[kind].get('language') or ''}\n{text}\n```"
            elif kind == "divider":
                yield "---"
            elif text:
                yield "  " * depth + mark + text
            if b.get("has_children"):
                yield from lines(b["id"], depth + 1)

    pages = [task["page"]] if task.get("page") else (p["id"] for p in _cursored(call, f"https://api.notion.com/v1/databases/{task['database']}/query", {"page_size": 100}, "results"))
    for p in pages:
        yield f"notion:{p}", "\n".join(lines(p, 0)), {"id": p}


def search(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """Hits of a search service that counts from 1 (``display``, ``start``), marks taken out."""
    for x in _offset(call, "https://openapi.naver.com/v1/search/" + (task.get("kind") or "blog") + ".json", {"query": task["query"], "display": 100}, "start", "items", 1):
        clean = lambda t: unescape(re.sub(r"<[^>]+>", "", t or ""))
        yield x["link"], f"# {clean(x['title'])}\n\n{clean(x.get('description'))}", {"date": x.get("postdate") or x.get("pubDate")}


def posts(call: Call, task: dict[str, Any]) -> Iterator[Item]:
    """Posts of an author by GraphQL, each page after the last post's id."""
    cursor = None
    query = "query Posts($username: String, $cursor: ID) { posts(username: $username, cursor: $cursor) { id title body url_slug released_at } }"
    while found := call("https://v2.velog.io/graphql", {"query": query, "variables": {"username": task["user"], "cursor": cursor}})["data"]["posts"]:
        for x in found:
            yield f"https://velog.io/@{task['user']}/{x['url_slug']}", f"# {x['title']}\n\n{x['body']}", {"released": x.get("released_at")}
        cursor = found[-1]["id"]


SERVICES: dict[str, tuple[Service, int]] = {
    "github_code": (github_code, 0), "github_issues": (github_issues, 20), "mongodb": (mongodb, 5000), "rss": (rss, 10), "web_page": (web_page, 0), "wikipedia": (wikipedia, 0), "transcript": (transcript, 0), "playlist": (playlist, 20), "drive": (drive, 0),
    "mail": (mail, 10), "slack": (slack, 20), "discord": (discord, 20), "jira": (jira, 20), "confluence": (confluence, 10), "notion": (notion, 0), "search": (search, 20), "posts": (posts, 20),
}


def _numbered(call: Call, address: str, parameters: dict[str, Any], number: str, field: str | None) -> Iterator[Any]:
    page = 1
    while found := (lambda a: a if field is None else a[field])(call(address, parameters | {number: page})):
        yield from found
        page += 1


def _tokened(call: Call, address: str, parameters: dict[str, Any], field: str) -> Iterator[Any]:
    token = None
    while True:
        answer = call(address, parameters | ({"pageToken": token} if token else {}))
        yield from answer.get(field) or []
        token = answer.get("nextPageToken")
        if not token:
            return


def _cursored(call: Call, address: str, parameters: dict[str, Any], field: str) -> Iterator[Any]:
    cursor = None
    while True:
        answer = call(address, parameters | ({"cursor": cursor, "start_cursor": cursor} if cursor else {}))
        yield from answer.get(field) or []
        cursor = answer.get("next_cursor") or (answer.get("response_metadata") or {}).get("next_cursor")
        if not cursor:
            return


def _offset(call: Call, address: str, parameters: dict[str, Any], name: str, field: str, first: int = 0) -> Iterator[Any]:
    at = first
    while found := call(address, parameters | {name: at}).get(field) or []:
        yield from found
        at += len(found)


def feed_entries(data: str | bytes) -> list[dict[str, str]]:
    """(title, link, summary, content, published) of the entries of an RSS or Atom feed."""
    name = lambda n: n.tag.rsplit("}", 1)[-1].lower()
    out = []
    for e in [n for n in ElementTree.fromstring(data).iter() if name(n) in ("item", "entry")]:
        field: dict[str, str] = {}
        for c in e:
            text = c.attrib.get("href") if name(c) == "link" and "href" in c.attrib else "".join(c.itertext())
            field.setdefault(name(c), (text or "").strip())
        out.append({"title": field.get("title", ""), "link": field.get("link", ""), "summary": field.get("description") or field.get("summary", ""), "content": field.get("encoded") or field.get("content", ""), "published": field.get("pubdate") or field.get("published") or field.get("updated", "")})
    return out


def message(data: bytes) -> dict[str, Any]:
    """(subject, from, to, date, body) of a mail; an HTML body wins over a plain one, headers are decoded."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    part = m.get_body(("html", "plain"))
    body = part.get_content() if part is not None else ""
    return {"subject": str(m["subject"] or ""), "from": str(m["from"] or ""), "to": str(m["to"] or ""), "date": str(m["date"] or ""), "body": readable(body) if part is not None and part.get_content_subtype() == "html" else body.strip()}


_BLOCKS = re.compile(r"(?is)<(h[1-6]|p|li|pre|blockquote|td)\b[^>]*>(.*?)</\1\s*>")
_ASIDE = re.compile(r"(?is)<(script|style|noscript|iframe|head|nav|header|footer|aside|form)\b[^>]*>.*?</\1\s*>|<!--.*?-->")


def _title(html: str) -> str:
    m = re.search(r"(?is)<title[^>]*>(.*?)</title>", html or "")
    return unescape(m[1]).strip() if m else ""


def readable(html: str | None) -> str:
    """The main text of a page as Markdown: headings, paragraphs, list items and quotations without what stands beside them.

    An article or main part is taken if there is one; blocks that are mostly links are left out.
    """
    text = _ASIDE.sub("", html or "")
    if m := re.search(r"(?is)<(article|main)\b[^>]*>(.*)</\1\s*>", text):
        text = m[2]
    strip = lambda x: re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]+>", "", x))).strip()
    out = []
    for m in _BLOCKS.finditer(text):
        tag, body = m[1].lower(), strip(m[2])
        linked = sum(len(strip(a)) for a in re.findall(r"(?is)<a\b[^>]*>(.*?)</a\s*>", m[2]))
        if body and not (tag in ("li", "td") and linked > 0.6 * len(body)):
            out.append(("#" * int(tag[1]) + " " if tag[0] == "h" else "- " if tag == "li" else "> " if tag == "blockquote" else "") + body)
    return "\n\n".join(out) or strip(text)


def read(tasks: DataFrame, service: str, client: Callable[[], Call], limit: int | None = None, task: str = "task") -> DataFrame:
    """(task, source, content, meta, success, error): the items of each task (a JSON text), up to the service's limit.

    ``client`` makes a call on the executor; ``limit`` 0 is none. Null tasks fail like any other.
    """
    items, usual = SERVICES[service]
    most = usual if limit is None else limit

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = None
        for pdf in batches:
            rows = []
            for t in pdf["task"]:
                try:
                    call = call or client()
                    options = json.loads(t)
                    for source, content, meta in islice(items(call, options), most or None):
                        rows.append((t, source, content, {k: str(v) for k, v in meta.items() if v is not None}, True, None))
                except Exception as e:
                    rows.append((t, None, None, None, False, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["task", "source", "content", "meta", "success", "error"])

    return tasks.select(F.col(task).cast("string").alias("task")).mapInPandas(run, SCHEMA)
