"""DataFrame operators: segmentation, detection, rule filters, findings, column discovery, reports."""
