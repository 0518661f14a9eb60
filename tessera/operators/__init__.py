"""DataFrame operators over the document-term and document-author relations."""
