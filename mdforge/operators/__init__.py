"""DataFrame -> DataFrame operators (HTML, URLs, policy, links, chunks, crawl)."""
