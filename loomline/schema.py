"""Schemas of landed payloads and of the canonical tables."""

from __future__ import annotations

PERSON = "struct<__typename:string,is_bot:boolean,actor_hash:string>"
PULL_REQUEST = (
    "repo string, number int, title string, body string, headRefName string, createdAt string, mergedAt string, closedAt string, "
    f"changedFiles int, additions int, deletions int, mergeCommit struct<oid:string>, author {PERSON}, mergedBy {PERSON}, milestone struct<title:string>, labels array<string>, "
    f"reviews struct<nodes:array<struct<state:string,submittedAt:string,author:{PERSON}>>>, "
    f"timelineItems struct<nodes:array<struct<__typename:string,createdAt:string,actor:{PERSON},requestedReviewer:struct<actor_hash:string,slug:string>>>>, "
    f"commits struct<totalCount:int,nodes:array<struct<commit:struct<oid:string,authoredDate:string,additions:int,deletions:int,changedFiles:int,author:struct<user:{PERSON}>>>>>, "
    "closingIssuesReferences struct<nodes:array<struct<number:int,repository:struct<nameWithOwner:string>>>>"
)
ISSUE = (
    "key string, fields struct<created:string,updated:string,resolutiondate:string,components:array<struct<name:string>>,issuetype:struct<name:string>,"
    "priority:struct<name:string>,resolution:struct<name:string>,parent:struct<key:string>>"
)
CHANGELOG = (
    "key string, histories array<struct<id:string,created:string,author:struct<actor_hash:string,is_bot:boolean>,"
    "items:array<struct<field:string,fieldtype:string,fromString:string,toString:string>>>>"
)
EVENT_COLUMNS = ("event_id", "work_item_id", "actor_hash", "activity", "ts", "source", "attrs")
ATTRS = (
    "ingest_source", "sha", "pr_number", "merge_commit_sha", "authored_by", "run_id", "head_sha", "conclusion", "attempt",
    "from_status", "to_status", "requested_reviewer", "review_state", "actor_absent", "repo", "completed_at",
)
