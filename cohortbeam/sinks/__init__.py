"""Writers: scored tables, results log, JSON documents, training export."""
