"""Errors with a code and metadata."""

from __future__ import annotations


class SiftwellError(Exception):
    code = "RAG_ERROR"

    def __init__(self, message: str, **metadata):
        super().__init__(message)
        self.metadata = metadata

    def to_json(self) -> dict:
        return {"name": type(self).__name__, "message": str(self), "code": self.code, "metadata": self.metadata}


def _maker(message: str, *names: str):
    @classmethod
    def make(cls, *values, **more):
        given = dict(zip(names, values, strict=False)) | more
        return cls(message.format(**{n: given.get(n) for n in names}), **given)

    return make


class EmbeddingError(SiftwellError):
    code = "EMBEDDING_ERROR"
    model_not_found = _maker("Embedding model not found: {model}", "model")
    dimension_mismatch = _maker("Expected {expected} dimensions, got {actual}", "expected", "actual")
    batch_too_large = _maker("Batch of {size} exceeds {limit}", "size", "limit")
    network_error = _maker("Embedding service failed: {cause}", "cause")


class RetrievalError(SiftwellError):
    code = "RETRIEVAL_ERROR"
    empty_vector_store = _maker("No documents in store")
    invalid_top_k = _maker("Invalid k: {k}", "k")
    filter_no_results = _maker("No documents match filters", "filters")
    score_below_threshold = _maker("Best score {actual} is under {floor}", "floor", "actual")


class DocumentLoadError(SiftwellError):
    code = "DOCUMENT_LOAD_ERROR"
    file_not_found = _maker("File not found: {path}", "path")
    unsupported_format = _maker("Unsupported file format: {format}", "path", "format")
    parsing_error = _maker("Cannot parse {path}: {cause}", "path", "cause")
    dependency_missing = _maker("{dependency} is needed to read {format}", "format", "dependency")


class VectorStoreError(SiftwellError):
    code = "VECTOR_STORE_ERROR"
    document_not_found = _maker("Document not found: {id}", "id")
    duplicate_id = _maker("Duplicate id: {id}", "id")
    invalid_document = _maker("Invalid document: {reason}", "reason")
    connection_error = _maker("Cannot open {store}: {cause}", "store", "cause")
    invalid_query = _maker("Invalid query: {reason}", "reason")


class GenerationError(SiftwellError):
    code = "GENERATION_ERROR"
    model_not_available = _maker("Model not available: {model}", "model")
    context_too_long = _maker("{tokens} tokens exceed {limit}", "tokens", "limit")
    streaming_not_supported = _maker("{client} cannot stream", "client")


class ConfigurationError(SiftwellError):
    code = "CONFIGURATION_ERROR"
    missing_required = _maker("Missing parameter: {name}", "name")
    invalid_value = _maker("Invalid value for {name}: {value}, expected {expected}", "name", "value", "expected")
    incompatible_options = _maker("{first} and {second} exclude each other", "first", "second")


def is_error(e: BaseException) -> bool:
    return isinstance(e, SiftwellError)


def error_code(e: BaseException) -> str:
    return e.code if is_error(e) else "UNKNOWN_ERROR"


def error_metadata(e: BaseException) -> dict:
    return e.metadata if is_error(e) else {}
