"""A small corpus of code of our own, for queries and tests of the syntax-aware functions."""

SNIPPETS = [
    ("python", "def total(xs):\n    s = 0\n    for x in xs:\n        s = s + x\n    return s\n"),
    ("python", "import heapq\n\n\nclass Solution2:\n    # Time: O(n^2)\n    def pairs(self, xs):\n        n = 0\n        for i in range(len(xs)):\n            for j in range(i):\n                if xs[i] > xs[j] and i != j:\n                    n = n + 1  # complexity grows\n        return n\n"),
    ("python", "def fib(n):\n    if n < 2:\n        return n\n    return fib(n - 1) + fib(n - 2)\n"),
    ("python", "def broken(:\n    pass\n"),
    ("python", "def text():\n    return 'O(n) # Time: none'\n"),
    ("java", "import java.util.*;\nclass Main {\n  // Time: O(n)\n  int f(int n) {\n    int s = 0;\n    for (int i = 0; i < n; i++) { if (i % 2 == 0) { s += i; } }\n    return s;\n  }\n}\n"),
    ("cpp", "#include <vector>\nint count(std::vector<int> v) {\n  int n = 0; /* Space: O(1) */\n  while (n < 10) { n++; }\n  return n;\n}\n"),
    ("go", "package main\nfunc sum(xs []int) int {\n\ts := 0\n\tfor _, x := range xs {\n\t\tif x > 0 {\n\t\t\ts += x\n\t\t}\n\t}\n\treturn s\n}\n"),
    ("javascript", "function g(a) {\n  for (const x of a) { if (x) { return x; } }\n  return null; // O(n) worst\n}\n"),
    ("ruby", "class Solution\n  def twice(x)\n    # complexity: O(1)\n    x.each do |y|\n      puts y if y > 1\n    end\n    x * 2\n  end\nend\n"),
    ("rust", "fn main() {\n    let mut i = 0;\n    loop {\n        i += 1;\n        if i > 3 { break; }\n    }\n}\n"),
    ("swift", "func f(_ n: Int) -> Int {\n    var s = 0\n    for i in 0..<n { s += i }\n    return s\n}\n"),
    ("php", "<?php\nfunction f($n) {\n  # Time: O(n)\n  foreach ($n as $x) { if ($x) { echo $x; } }\n}\n"),
    ("c", "int f(int n) {\n  int s = 0;\n  do { s += n; n--; } while (n > 0);\n  return s;\n}\n"),
    ("csharp", "using System;\nclass P {\n  static int F(int n) {\n    switch (n) { case 1: return 1; default: return F(n - 1); }\n  }\n}\n"),
    ("typescript", "function h(n: number): number {\n  while (n > 0) { n = n - 1; }\n  return n;\n}\n"),
]
