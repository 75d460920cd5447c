"""Where documents, embeddings and registries come from and go to."""
