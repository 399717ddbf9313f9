"""The archive's tables as Spark types, and the bundle of them that views and mutations take."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

_PERSONS = "array<struct<name:string,address:string>>"
RECIPIENTS = f"struct<to:{_PERSONS},cc:{_PERSONS},bcc:{_PERSONS}>"

EMAILS = (
    "id string, thread_id string, ingestion_source_id string, import_source string, message_id_header string, "
    "provider_message_id string, sent_at long, sent_at_kind string, subject string, sender_name string, sender_email string, "
    f"recipients {RECIPIENTS}, storage_path string, storage_hash_sha256 string, size_bytes long, has_attachments boolean, "
    "archived_at long, source_path string, duplicate_subject_hash string, duplicate_body_hash string, "
    "duplicate_recipient_fingerprint string, duplicate_attachment_fingerprint string, remote_content_status string, "
    "remote_content_asset_count long, remote_content_archived_at long, tags array<string>, deleted_at long"
)
ATTACHMENTS = (
    "id string, filename string, mime_type string, size_bytes long, content_hash_sha256 string, storage_path string, "
    "ingestion_source_id string, content_description string, original_created_at string, original_modified_at string, extracted_text string"
)
LINKS = "email_id string, attachment_id string"
ASSETS = (
    "id string, email_id string, original_url string, final_url string, url_hash string, status string, "
    "content_type string, size_bytes long, storage_path string, failure_reason string"
)
SOURCES = (
    "id string, name string, provider string, provider_config string, status string, last_import_started_at long, "
    "last_import_finished_at long, last_import_status_message string, merged_into_id string, created_at long, updated_at long"
)
SESSIONS = (
    "id string, ingestion_source_id string, is_initial_import boolean, total_mailboxes long, completed_mailboxes long, "
    "failed_mailboxes long, error_messages array<string>, created_at long, last_activity_at long, total_bytes long, processed_bytes long"
)
CONTACTS = "id string, email string, display_name string"
JOBS = (
    "id string, queue string, name string, payload string, state string, attempts long, max_attempts long, run_at long, "
    "singleton_key string, error string, created_at long, started_at long, finished_at long"
)
IGNORES = "fingerprint string, created_at long"
SEARCH_DOCS = "email_id string, subject string, body string, sender string, recipients string, attachments string, meta string"

SCHEMAS = {
    "emails": EMAILS, "attachments": ATTACHMENTS, "links": LINKS, "assets": ASSETS, "sources": SOURCES, "sessions": SESSIONS,
    "contacts": CONTACTS, "jobs": JOBS, "ignores": IGNORES, "docs": SEARCH_DOCS,
}


@dataclass(frozen=True)
class Archive:
    """The archive's tables; a mutation returns a new bundle and leaves the old one as it is."""

    emails: DataFrame
    attachments: DataFrame
    links: DataFrame
    assets: DataFrame
    sources: DataFrame
    sessions: DataFrame
    contacts: DataFrame
    jobs: DataFrame
    ignores: DataFrame
    docs: DataFrame

    def with_tables(self, **tables: DataFrame) -> Archive:
        return replace(self, **tables)

    @classmethod
    def empty(cls, spark: SparkSession, **tables: DataFrame) -> Archive:
        return cls(**{k: tables.get(k) if tables.get(k) is not None else spark.createDataFrame([], s) for k, s in SCHEMAS.items()})
