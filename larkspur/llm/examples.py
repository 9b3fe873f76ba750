"""Plain text that uses the signs of markup: what the markup classifier learns not to touch.

Written by hand from common knowledge of the languages named, a source a language or field; no line comes from a table.
``{w}`` stands for a word, ``{ws}`` for one to three words, ``{n}`` and ``{m}`` for numbers, ``{c}`` for a letter.
"""

from __future__ import annotations

PLAIN: dict[str, list[str]] = {
    "python": [
        "def {w}(*args, **kwargs): return {n}", "{w}.__init__ calls super().__init__()", "if __name__ == main", "{w}_{w}_{n} = [{n}, {m}]", "self._{w} = {w}[{n}]", "@{w} above def {w}", "{w}(**options) and {w}(*rest)",
        "{c} = {n} ** {m}", "{w}[{n}:{m}] + {w}[-{n}]", "lambda {c}: {c} * {n}", "the dunder names __len__ and __repr__", "{w}['{w}'] |= {n}", "# {w} is {n} here", "x = {{{c}: {n}}}", "print(f'{{{w}}}')", "{w}._{w}_", "{n}_000 rows",
    ],
    "c": [
        "#include <{w}.h>", "#define {w} {n}", "int *{w} = &{w};", "{w}->{w} = {n};", "for (i = {n}; i < {m}; i++)", "if (a < b && c > {n})", "{w}[{n}] = {w} & {m};", "std::vector<int> {w};", "unsigned {c} : {n};", "x << {n} | y >> {m}", "char **{w}", "printf(\"%d\\n\", {w})",
        "map<{w}, {w}> {c}", "template <class T> struct {w}", "a ? b : c", "{w} != {w} || !{w}", "/* {w} {n} */", "return -{n} <= {c};", "#ifdef {w}",
    ],
    "java": ["List<String> {w} = of()", "Map<Integer, {w}> {w}", "{c} -> {c} + {n}", "@Override public {w}", "{w}<T extends {w}>", "int[] {w} = new int[{n}]", "Optional<{w}> {c}", "{w}::{w}", "if ({w} == null || {n} > {m})", "Comparable<{w}>", "{w}.<String>{w}()", "catch (A | B {c})"],
    "rust": ["fn {w}(x: &str) -> Option<u8>", "let {w} = &mut {w}[{n}..];", "Vec<{w}>", "Result<(), {w}>", "#[derive({w})]", "match {c} {{ _ => {n} }}", "|{c}| {c} * {n}", "*{w} += {n}", "impl<T> {w} for {w}", "'{c} lifetime of &'{c} str", "a => b"],
    "shell": [
        "export {w}=$HOME/{w}", "echo $1 ${w} $?", "cat {w} | sort | uniq -c > {w}", "{w} 2>&1", "ls *.{w}", "rm -rf ~/{w}/*", "#!/bin/sh", "grep -E '{w}|{w}' {w}", "[ -f {w} ] && {w}", "{w} < {w} > {w}", "{w} & {w} &", "sed 's/{w}/{w}/'", "~{w} and ~/.{w}", "$(({n} + {m}))", "{w} || exit {n}", "{w} >> {w}.log", "# {w} -- {w}",
    ],
    "regex": ["\\d+ and \\w", "the class \\s matches", "^[a-z]+$", "{w}.*{w}", "(?:{w}|{w})", "[^{c}]*", "{c}{{{n},{m}}}", "\\b{w}\\b", "[A-Z]\\.", "\\(\\d\\)", "a* matches a|b"],
    "r": ["{c} <- {n}", "{w} <- {w}({n}, {m})", "{n} -> {c}", "{w}${w}", "{w}[{n}, ]", "{w} ~ {w} + {w}", "{w} %>% {w}", "{c} <<- {n}", "lm({w} ~ {w})", "{w}[[{n}]]", "f <- g -> h"],
    "paths": [
        "C:\\{w}\\{w}.txt", "D:\\{w}", "in E:\\{w}\\{w}\\{w} there", "\\\\{w}\\{w}", "~/{w}/{w}.conf", "/{w}/{w}_{n}", "%{w}%\\{w}", "{w}\\{w}\\{w}", "*.{w} files", "file_{n}_{w}.txt", "#{w} on {w}", "{w}@{w}.org", "s3:{w}", "{w}?{c}={n}&{c}={m}", "C:\\{w}\\New", "C:\\Users\\{w}",
    ],
    "maths": [
        "{n} < {m}", "{c} > {n}", "a < b < c", "p<{n}", "{n} * {m} * {n}", "{n}*{m}", "2^{n}", "x^2 + y^2", "{c}_{n} and {c}_{m}", "f(x) = {n} * x", "{{a, b}}", "{{{c}, {c}}} of {n}", "|x| > {n}", "{n} | {m}", "~{n}%", "~ {n}", "a ~ b", "{n} = {m}", "{c} == {n}", "= {n}", "== {m} ==>", "x <= y => z", "A -> B <- C", "x <-> y",
        "#{n} of {m}", "{n}% & {m}%", "[{n}, {m}]", "({n}, {m}]", "sqrt({n}) != {m}", "n! / {n}", "<{n}", "< {n} {w}", "{n}->{m}", "x <{n}> y", "e^-{c}", "10^{n}",
    ],
    "prices": ["${n}", "${n}.{m}", "$ {n}", "US${n}", "${n} or ${m}", "from ${n} to ${m}", "{n}$ + {m}$", "{n}$", "${n}k-${m}k", "costs $5, then $6", "€{n}, ${m}", "A$ {n}"],
    "prose": [
        "R&D", "AT&T", "Q&A {w}", "{w} & {w}", "{c}&{c};", "B&B, {w}", "C# and F#", "#{w}", "# {n} in the list", "No. #{n}", "[sic]", "[{n}]", "(cf. [{n}])", "as {w} [{n}] shows", "[{w}]", "{w}[{n}]", "{w} [{n}, p. {m}]", "note* below", "{w}* and {w}*", "* {w}", "*) {w}", "(* {w} *)", "(* {w} *) {ws} (* {w} *)", "{w} *) {ws} (* {w}", "let {c} = {n} *) in (* {w}", "(*) {ws} (*)", "{w} &{w}; {w}", "{w}_", "_{w}", "snake_{w}_case", "_ {w} _",
        "<3", ":* and <3", "^_^", "<- {w}", "-> {w}", "-- {w}", "{w} -- {w}", "{w}'s", "'{w}'", "the '{w}' of", "'' {w}", "\"{w}\"", "{w} | {w}", "{w}|{w}", "@{w}", "~{w}", "{w}~", "`{w}", "{w}`s", "\\{w}", "\\ {w}", "{w}/{w}", "<{w} here", "<< {w}", "{w} >> {w}", "<{w}", "> {w}?", "5 > {n}", "***", "* * *", "- - -", "= {w}", "{{{w}}}", "{{ {w}", "{w} }}", "&{w}", "& {w}", "{w}#", "%{w}%", "{w}^{n}", "^{n}",
    ],
}
#: Plain signs that take a line.
PLAIN_LINES = ["- {ws}", "* {ws}", "+ {ws}", "{n}. {ws}", "{n}) {ws}", "-- {w}", "-> {ws}", "$ {ws}", "# {n}", "#{w}", "a | b", "* * *", "== {n}", "~ {ws}"]
