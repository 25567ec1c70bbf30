"""DataFrame operators: ranking, vocabulary, similarity, versions, embeddings."""
