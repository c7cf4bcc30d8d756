"""Sources and sinks: tables, annotated corpora, document and workbook packages, manifests."""
