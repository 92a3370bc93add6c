"""DataFrame operators for document corpora and the knowledge graphs drawn from them."""
