"""DataFrame in, DataFrame out; nothing is collected inside, but for results whose size is stated."""
