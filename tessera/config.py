"""Settings of retrieval, ingestion and page processing, with the values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Limits and depths. Each may be overridden by making another instance."""

    # retrieval
    max_query_tokens: int = 64
    most_query_tokens: int = 4096
    target_hits_per_token: int = 100
    default_hits: int = 3
    rerank_count: int = 100
    app_rerank_fetch: int = 20
    app_rerank_keep: int = 5
    grid_side: int = 32
    patch_count: int = 1024
    snippet_chars: int = 200
    context_chars: int = 300
    # pages
    region_min_pixels: int = 2_800_000
    region_min_side: int = 200
    region_min_area: int = 100_000
    max_regions: int = 12
    tile_side: int = 1800
    tile_overlap: int = 100
    crop_padding: int = 20
    # files and synchronisation
    max_upload_mb: int = 250
    max_download_mb: int = 100
    download_types: tuple[str, ...] = ("pdf", "jpg", "jpeg", "png", "gif", "tiff")
    processable_types: tuple[str, ...] = ("pdf", "jpg", "jpeg", "png", "gif", "tiff", "tif")
    excluded_tables: tuple[str, ...] = ("_prisma_migrations", "sync_events", "webhook_*", "api_credentials", "integration_*", "processed_webhook_events", "audit_records")
    timestamp_columns: tuple[str, ...] = ("updated_at", "last_synced_at", "created_at")
    max_tags: int = 20
    max_tag_chars: int = 50
    max_title_chars: int = 200
    max_description_chars: int = 1000
    bm25_k1: float = 1.2
    bm25_b: float = 0.75


DEFAULT = Settings()
