"""The public names of the engine."""

from loomspark.budget import KNOWN_MODELS, chunk_budget, resolve, resolve_models, with_known_model
from loomspark.functions.tokenizers import Spec, WordPieceOptions, WordPieceTokenizer
from loomspark.operators.chunk import chunk_list, chunk_requests, chunk_table, chunk_text, chunk_to_list, chunk_to_result, diagnostics, summary
from loomspark.operators.evaluation import best, score, span_scores, sweep
from loomspark.operators.integrity import violations
from loomspark.operators.requests import flatten
from loomspark.options import ChunkingError, ChunkingOptions, InvalidChunkingOptions, TokenizerResolution
from loomspark.plans.sql import register
from loomspark.sources.files import decode_column, read_files
from loomspark.sources.ingestion import ingestion_chunks, to_markdown
from loomspark.streaming.chunks import chunk_stream, write_chunks

__all__ = [n for n in dir() if not n.startswith("_")]
