"""The registered queries of the engine and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.plans import oracles
from pagemill.plans import queries as q

_QUERIES = (
    q.page_number_lines, q.running_lines, q.body_lines, q.paragraphs, q.char_index, q.toc_headings, q.sections, q.position_to_chapter, q.chapter_levels, q.position_to_section, q.hits_in_sections, q.open_position, q.sentence_at, q.speech_cursor,
    q.library_sorts, q.collection_names, q.collection_toggle, q.auto_status, q.lookup_url, q.escaped_html, q.scan_pages, q.scan_layers, q.recognised_lines, q.job_control,
    q.retry_classes, q.fenced_json, q.english_books, q.loaded_ranks, q.matched_case, q.repaired_tokens,
    q.percent_to_block, q.approx_pages, q.page_to_block, q.search_hits, q.search_snippets, q.word_ranks, q.dictionary_ratio, q.text_quality,
    q.poor_docs, q.split_glued, q.join_broken_words, q.respell, q.segment_words, q.letter_spacing, q.stray_marks, q.sentences, q.word_at,
    q.word_spans, q.library_view, q.library_by_author, q.status_of, q.collections, q.cover_hue, q.bold_starts, q.reading_days, q.stats_view,
    q.failure_streaks, q.rebuild_triggers, q.stored_library, q.reading_position, q.render_scales, q.provider_outcome, q.ewma_latency, q.size_mode, q.index_percentiles, q.notes_export, q.resolve_links,
    q.html_title_links, q.contrast_ratio, q.html_blocks, q.inline_markup, q.outline_walk, q.nav_toc, q.spine_sections, q.assembled_lines, q.page_statistics, q.printed_lines, q.book_blocks, q.headings, q.mended_line_ends, q.repaired_pages, q.transcribed_lines, q.outline_toc,
    q.image_preprocess,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracles.sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running lines dropped, paragraphs rebuilt, each with its place in the document."""
    lines = q.layout.drop_running(q.layout.lines(q.docs(spark, sf_dir)))
    return q.layout.char_index(q.layout.blocks(lines)).orderBy("doc_id", "block")
