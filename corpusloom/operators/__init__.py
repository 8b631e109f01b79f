"""DataFrame operators: snapshots, chunks, search, graph, schemas, pages and answers."""
