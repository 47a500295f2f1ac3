"""Document sources: files to (source_path, document_id, content, format) rows, with a state per file."""

from .files import *  # noqa: F403
from .pages import *  # noqa: F403
